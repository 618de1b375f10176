"""The archive: accounts, ingest, classification, scans and exports over versioned state tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.config import dotted
from postmill.functions.mime import record_columns, with_parsed
from postmill.functions.privacy import Security
from postmill.functions.text import date_band, label_name, safe_filename, slug
from postmill.limits import PackLimits
from postmill.operators import classify, exports, packs, state, taxonomy
from postmill.operators.rules import Rule
from postmill.operators.threads import thread_table
from postmill.schemas import MIGRATIONS, TABLES
from postmill.session import scratch
from postmill.sources import sinks
from postmill.sources.mbox import file_facts, read_mbox

MAX_BODY_CHARS = 50_000
#: Places of a mailbox in one commit, unless configured.
BATCH = 1_000_000


class AccountError(Exception):
    pass


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def rules_of(config: dict) -> list[Rule]:
    return [Rule.of(x) for x in dotted(config, "classification.rules", None) or config.get("rules") or []]


class Archive:
    """One archive under a root folder.  A change takes effect for all tables it touches at once."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None):
        self.spark, self.config = spark, config or {}
        self.store = state.StateStore(spark, root)
        self.root = root

    # -- tables ------------------------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.store.read(name, TABLES[name])

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[name])

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _append(self, name: str, rows: DataFrame) -> None:
        self.store.append(name, self._shaped(name, rows))

    def _next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def migrate(self) -> list[str]:
        """Apply the schema versions that the store lacks, in order; returns their names.

        A store with messages and without a version table is taken to be at the first version.  A version makes the
        tables it introduces; older rows read its new columns as null.
        """
        done = [r["version"] for r in self.table("schema_migrations").collect()]
        present = self.store.current()
        if "messages" in present and "schema_migrations" not in present:
            done = [MIGRATIONS[0][0]]
        applied = [version for version, _ in MIGRATIONS if version not in done]
        with self.store.change() as made:
            for version, tables in MIGRATIONS:
                for name in tables if version in applied else ():
                    made.create(name)
            if applied or "schema_migrations" not in present:
                fresh = [] if "schema_migrations" in present else [v for v in done if v not in applied]
                made.append("schema_migrations", self._rows("schema_migrations", [(v, _now()) for v in fresh + applied]))
        return applied

    def initialize(self) -> list[str]:
        """Bring the store to the newest schema version; returns the tables that were made."""
        before = set(self.store.tables())
        self.migrate()
        return [t for t in TABLES if t in set(self.store.tables()) - before]

    # -- accounts ----------------------------------------------------------------------------------------------
    def account(self, key: str) -> dict | None:
        row = self.table("accounts").filter(F.col("account_key") == key).first()
        return row.asDict() if row else None

    def accounts(self) -> list[dict]:
        return [r.asDict() for r in self.table("accounts").orderBy("account_key").collect()]

    def add_account(self, key: str, display_name: str | None = None, email: str | None = None, provider: str = "gmail",
                    notes: str | None = None) -> dict:
        if self.account(key):
            raise AccountError(f"account {key!r} exists")
        self._append("accounts", self._rows("accounts", [(key, display_name, email, provider, notes, _now())]))
        return self.account(key)

    def update_account(self, key: str, **changes: str | None) -> bool:
        """False when there is nothing to set or no such account."""
        changes = {k: v for k, v in changes.items() if v is not None}
        if not changes or not self.account(key):
            return False
        hit = F.col("account_key") == key
        rows = self.table("accounts")
        self.store.write("accounts", rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()}))
        return True

    def resolve_account(self, key: str | None) -> dict:
        """The account named, or the only one there is."""
        if key:
            found = self.account(key)
            if not found:
                raise AccountError(f"no account {key!r}")
            return found
        known = self.accounts()
        if len(known) != 1:
            raise AccountError("no account yet" if not known else "several accounts: name one")
        return known[0]

    def default_account(self) -> dict:
        return self.account("default") or self.add_account("default", "Default")

    # -- ingest ------------------------------------------------------------------------------------------------
    def _source(self, path: str, name: str | None, account: str) -> int:
        known = self.table("mbox_sources")
        row = known.filter((F.col("file_path") == path) & (F.col("account_key") == account)).first()
        if row:
            return row["source_id"]
        label = name or Path(path).stem
        source_id = (known.agg(F.max("source_id")).first()[0] or 0) + 1
        fact = file_facts(self.spark, path)
        rows = self.spark.range(1).select(
            F.lit(source_id).alias("source_id"), F.lit(account).alias("account_key"), F.lit(path).alias("file_path"),
            F.lit(label).alias("source_name"), slug(F.lit(label)).alias("source_slug"), F.lit(fact["size"]).alias("file_size"),
            F.timestamp_millis(F.lit(fact["modified"])).alias("file_mtime"), F.lit(fact["sha256"]).alias("sha256"))
        self._append("mbox_sources", rows)
        return source_id

    def _run(self, run: dict, made: state.Change | None = None) -> None:
        if made is None:
            with self.store.change() as made:
                return self._run(run, made)
        rows = self.spark.createDataFrame([run], TABLES["ingest_runs"])
        made.replace("ingest_runs", state.replace_rows(made.read("ingest_runs", TABLES["ingest_runs"]), rows, ["id"]))

    def ingest(self, path: str, account: str, source_name: str | None = None, resume: bool = False, force: bool = False,
               extract: bool = False, create: bool = False, attachments_dir: str | None = None, to_disk: bool = True) -> dict[str, int]:
        """Add a mailbox file's messages.

        Messages are known by account, source and place in the file: known ones are skipped, with ``force`` replaced
        along with what depends on them.  Broken messages go to ingest_errors, and so do messages whose attachments
        cannot be read.  Each ``ingest.batch_commit_size`` places of the mailbox are one commit, together with the
        run's checkpoint.  An interrupt or a failure leaves the run ``interrupted`` at its last commit; ``resume``
        starts after the checkpoint of the open run, and the messages before it count as skipped.
        """
        if not self.account(account):
            if not create:
                raise AccountError(f"no account {account!r}; add it or ask to create it")
            self.add_account(account)
        source = self._source(path, source_name, account)
        runs = self.table("ingest_runs").filter(F.col("source_id") == source)
        point = state.resume_points(runs).first() if resume else None
        if not resume:
            open_runs = runs.filter("status = 'running'").withColumn("status", F.lit("interrupted"))
            if open_runs.take(1):
                self.store.write("ingest_runs", state.replace_rows(self.table("ingest_runs"), open_runs, ["id"]))
        run = {f.name: None for f in self.spark.createDataFrame([], TABLES["ingest_runs"]).schema.fields}
        run |= {"id": point["id"] if point else self._next_id("ingest_runs"), "source_id": source, "account_key": account,
                "status": "running", "started_at": _now(), "last_mbox_key": point["last_mbox_key"] if point else None}
        self._run(run)
        try:
            everything = read_mbox(self.spark, path)
            total = everything.agg(F.count("*").alias("n")).first()["n"]
        except Exception as error:
            self._run(run | {"status": "failed"})
            raise RuntimeError(f"the mailbox {path} cannot be read") from error
        counts = dict.fromkeys(("seen", "inserted", "replaced", "errors"), 0)
        begin = 0 if run["last_mbox_key"] is None else run["last_mbox_key"] + 1
        folder = attachments_dir or dotted(self.config, "paths.attachments_dir", None) or f"{self.root}/files"
        counts["skipped"] = min(begin, total)
        try:
            for batch in self._batches(everything, begin, total):
                self._load(batch, run, counts, force, (folder, to_disk) if extract else None)
        except BaseException as error:  # an interrupt, too, leaves a run that can be resumed
            with self.store.change() as made:
                self._threads(made, account, source)
                self._run(run | {"status": "interrupted"}, made)
            if isinstance(error, KeyboardInterrupt):
                return counts
            raise
        with self.store.change() as made:
            self._threads(made, account, source)
            self._run(run | {"status": "completed", "finished_at": _now()}, made)
        return counts

    def _batches(self, everything: DataFrame, begin: int, total: int) -> Iterator[DataFrame]:
        """The messages from ``begin`` on, in commits of a size; several are cut from the mailbox in one pass."""
        size = max(1, int(dotted(self.config, "ingest.batch_commit_size", None) or BATCH))
        todo = everything.filter(F.col("mbox_key") >= begin) if begin else everything
        if total - begin <= size:
            if total > begin:
                yield todo
            return
        where = scratch(self.spark, "mailbox")
        todo.withColumn("_batch", F.floor((F.col("mbox_key") - begin) / size)).write.partitionBy("_batch").parquet(where)
        for k in range(-(-(total - begin) // size)):
            yield self.spark.read.schema(everything.schema).parquet(f"{where}/_batch={k}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _threads(self, made: state.Change, account: str, source: int) -> None:
        """Replace the source's threads by those of its messages."""
        own = (F.col("account_key") == account) & (F.col("source_id") == source)
        found = thread_table(made.read("messages", TABLES["messages"]).filter(own), ["account_key", "source_id", "thread_key"])
        made.replace("threads", made.read("threads", TABLES["threads"]).filter(~own).unionByName(self._shaped("threads", found)))

    def _load(self, batch: DataFrame, run: dict, counts: dict[str, int], force: bool, extract: tuple[str, bool] | None) -> None:
        """Commit one batch of a run: its rows, and the run's checkpoint and counters."""
        limit = dotted(self.config, "ingest.max_body_chars", MAX_BODY_CHARS)
        account, source = run["account_key"], run["source_id"]
        with self.store.change() as made:
            known = made.read("messages", TABLES["messages"])
            mine = known.filter((F.col("account_key") == account) & (F.col("source_id") == source)).select("id", "mbox_key")
            first_id = (known.agg(F.max("id")).first()[0] or 0) + 1
            low, high, seen = batch.agg(F.min("mbox_key"), F.max("mbox_key"), F.count("*")).first()
            todo = batch if force else self._unknown(batch, mine.select("mbox_key"), low, high, seen)
            parsed = with_parsed(todo, payloads=extract is not None).drop("raw").persist()
            try:
                ok = parsed.filter("m.error_type IS NULL").select(
                    (F.lit(first_id - low) + F.col("mbox_key")).alias("id"), F.lit(account).alias("account_key"),
                    F.lit(source).alias("source_id"), "mbox_key", F.col("m.attachments").alias("_attachments"),
                    *[v.alias(k) for k, v in record_columns("m", limit).items()])
                wrong = parsed.select(
                    F.lit(account).alias("account_key"), F.lit(run["id"]).alias("ingest_run_id"), F.lit(source).alias("source_id"),
                    "mbox_key", F.coalesce("m.error_type", F.when(F.col("m.attachment_error").isNotNull(), "AttachmentError"))
                    .alias("error_type"), F.substring(F.coalesce("m.error_message", "m.attachment_error"), 1, 500).alias("error_message"))
                wrong = wrong.filter("error_type IS NOT NULL" if extract else "error_type IS NOT NULL AND error_type <> 'AttachmentError'")
                errors = parsed.filter("m.error_type IS NOT NULL").count()
                inserted = ok.count()
                gone = mine.join(ok.select("mbox_key"), "mbox_key", "left_semi").select(
                    "id", F.col("id").alias("message_db_id")) if force else None
                replaced = gone.count() if force else 0
                if replaced:
                    self._delete(made, gone)
                made.append("messages", self._shaped("messages", ok))
                labelled = ok.select("account_key", F.col("id").alias("message_db_id"), F.explode("labels").alias("label_name"))
                found = labelled.select("account_key", "label_name", label_name(F.col("label_name")).alias("normalized_name"))
                made.append("labels", state.absent(made.read("labels", TABLES["labels"]), found, ["account_key", "label_name"]))
                made.append("message_labels", self._shaped("message_labels", labelled.distinct()))
                if extract:
                    made.append("attachments", self._shaped("attachments", self._extract(ok, account, *extract)))
                made.append("ingest_errors", self._shaped("ingest_errors", wrong))
                # a broken message does not move the checkpoint
                last = batch.select("mbox_key").join(
                    parsed.filter("m.error_type IS NOT NULL").select("mbox_key"), "mbox_key", "left_anti").agg(
                    F.max("mbox_key")).first()[0] if errors else high
            finally:
                parsed.unpersist()
            done = {"seen": seen, "inserted": inserted, "replaced": replaced, "errors": errors, "skipped": seen - inserted - errors}
            done = {k: counts[k] + n for k, n in done.items()}
            after = run | {
                "last_mbox_key": run["last_mbox_key"] if last is None else last, "messages_seen": done["seen"],
                "messages_inserted": done["inserted"], "messages_skipped": done["skipped"],
                "messages_replaced": done["replaced"], "errors_count": done["errors"]}
            self._run(after, made)
        run.update(after)  # the commit has taken effect
        counts.update(done)

    @staticmethod
    def _unknown(batch: DataFrame, known: DataFrame, low: int, high: int, size: int) -> DataFrame:
        """The messages of a batch whose places are not known.

        Places are counted first: when none or all of them are known, no message needs to be shuffled for a join.
        """
        held = known.filter(F.col("mbox_key").between(low, high)).distinct().count()
        if not held:
            return batch
        if held == size == high - low + 1:
            return batch.limit(0)
        return batch.join(known, "mbox_key", "left_anti")

    def _delete(self, made: state.Change, gone: DataFrame) -> None:
        """Take messages and what depends on them out of a change's tables."""
        for name in ("attachments", "message_labels", "security_findings"):
            made.replace(name, state.without(made.read(name, TABLES[name]), gone, ["message_db_id"]))
        kept = made.read("classifications", TABLES["classifications"])
        made.replace("classifications", state.without(
            kept.filter("target_type = 'message'"), gone, ["message_db_id"]).unionByName(kept.filter("target_type <> 'message'")))
        made.replace("messages", state.without(made.read("messages", TABLES["messages"]), gone, ["id"]))

    def _extract(self, ok: DataFrame, account: str, folder: str, to_disk: bool) -> DataFrame:
        """Rows of the attachments, whose files are written unless ``to_disk`` is false."""
        parts = ok.select(
            F.col("id").alias("message_db_id"), "account_key", "source_id", "date_utc",
            F.coalesce("message_id", F.col("mbox_key").cast("string")).alias("_key"), F.inline("_attachments"))
        where = F.concat_ws("/", F.lit(folder), F.lit(account), date_band(F.col("date_utc")), slug(F.col("_key"), 60))
        parts = parts.withColumns({"folder": where, "safe_filename": safe_filename(F.col("original_filename"), F.col("idx"))})
        if to_disk:
            return sinks.store_attachments(parts, "folder", "safe_filename", [
                "message_db_id", "account_key", "source_id", "original_filename", "safe_filename", "content_type",
                "content_disposition", "size_bytes", "sha256"])
        status = F.when(F.col("size_bytes") > 0, "pending").otherwise("empty")
        return parts.withColumn("extraction_status", status)

    # -- classification ----------------------------------------------------------------------------------------
    def seed_categories(self, account: str | None = None) -> int:
        entries = dotted(self.config, "taxonomy.locked_categories", None) or dotted(self.config, "taxonomy.categories", []) or []
        entries = [e if isinstance(e, dict) else {"path": e, "locked": True} for e in entries]
        if not entries:
            return 0
        new = taxonomy.seed(self.table("categories"), taxonomy.category_rows(self.spark, entries, account))
        added = new.count()
        if added:
            self._append("categories", new)
        return added

    def classify(self, level: str = "message", account: str | None = None) -> dict[str, int]:
        """Run the rules over open messages or threads; threads pass their outcome on to their messages."""
        rules = rules_of(self.config)
        if not rules:
            return {"classified": 0, "skipped": 0}
        messages = exports.in_account(self.table("messages"), account)
        if level == "message":  # rules read no bodies
            messages = messages.select("id", "account_key", "thread_key", "sender", "recipients", "subject")
        known = self.table("classifications")
        base = self._next_id("classifications")
        if level == "message":
            found = classify.matched(classify.without_rule_rows(messages, known), rules).persist()
            rows = classify.message_rows(found).withColumn("id", F.lit(base) + F.col("message_db_id"))
        else:
            found = classify.match_threads(messages, known, rules).persist()
            first = messages.groupBy("account_key", "thread_key").agg(F.min("id").alias("_first"))
            own = classify.thread_rows(found).join(first, ["account_key", "thread_key"]).withColumn(
                "id", F.lit(base) + F.col("_first"))
            top = base + (messages.agg(F.max("id")).first()[0] or 0)
            passed = classify.inherited_rows(messages, known, found).withColumn("id", F.lit(top + 1) + F.col("message_db_id"))
            rows = own.drop("_first").unionByName(passed, allowMissingColumns=True)
        counts = classify.counters(found).first().asDict()
        self._append("classifications", rows)
        found.unpersist()
        return counts

    # -- scans -------------------------------------------------------------------------------------------------
    def scan(self, account: str | None = None) -> dict[str, int]:
        """Append findings of all bodies; every run appends again."""
        if not Security.of(self.config).scan_enabled:
            return {"scanned": 0, "findings": 0}
        rows = exports.in_account(self.table("messages"), account).filter("body_text IS NOT NULL")
        found = exports.security_findings(rows, "account_key").withColumns({
            "message_db_id": F.col("id"), "target_type": F.lit("message")})
        before = self.table("security_findings").count()
        self._append("security_findings", found)
        return {"scanned": rows.count(), "findings": self.table("security_findings").count() - before}

    # -- review ------------------------------------------------------------------------------------------------
    def review(self, account: str | None = None) -> tuple[list[dict], list[dict]]:
        """Visible categories with counts, and pending proposals."""
        shown = taxonomy.visible(self.table("categories"), account)
        rows = exports.in_account(self.table("classifications"), account)
        listed = taxonomy.counted(shown.select("path").distinct(), rows).orderBy("path")
        return ([r.asDict() for r in listed.collect()],
                [r.asDict() for r in taxonomy.pending(self.table("category_proposals"), account).collect()])

    def decide(self, proposal_id: int, approve: bool, note: str = "") -> str | None:
        """Approve or reject a proposal, with a note; the path that was added."""
        proposals = self.table("category_proposals")
        owner = proposals.filter(F.col("id") == proposal_id).select("account_key").first()
        changed, path = taxonomy.decide(proposals, proposal_id, approve, note, _now())
        with self.store.change() as made:
            made.replace("category_proposals", changed)
            if path:
                row = taxonomy.category_rows(self.spark, [{"path": path}], owner["account_key"])
                made.append("categories", self._shaped("categories", taxonomy.seed(self.table("categories"), row)))
        return path

    # -- exports -----------------------------------------------------------------------------------------------
    def export_packs(self, limits: PackLimits, out_dir: str, account: str | list[str], profile: str | None = None,
                     dry_run: bool = False, include_unclassified: bool = True) -> dict | list[dict]:
        """Write the packs, manifests and export log of an account, or of several in one plan; a dry run counts groups.

        Each account has a budget, manifests and a log row of its own.  For a list of accounts a list is returned.
        """
        keys = [account] if isinstance(account, str) else list(dict.fromkeys(account))
        messages = self.table("messages").filter(F.col("account_key").isin(keys))
        records = packs.export_records(messages, self.table("classifications"), Security.of(self.config), profile)
        if not include_unclassified:
            records = records.filter("_source = 0")
        stats = {k: {"account_key": k, "files_written": 0, "messages_exported": 0, "budget_used": 0, "dry_run": dry_run,
                     "manifest_csv": f"{out_dir}/{k}/manifest.csv", "manifest_json": f"{out_dir}/{k}/manifest.json", "groups": 0}
                 for k in keys}
        records = packs.with_chunks(records)
        if not dry_run:  # groups alone need no bodies
            records = records.persist()
        try:
            for r in records.select(*packs.GROUP).distinct().groupBy("account_key").count().collect():
                stats[r["account_key"]]["groups"] = r["count"]
            if not dry_run:
                self._write_packs(records, limits, out_dir, stats, profile)
        finally:
            if not dry_run:
                records.unpersist()
        found = [s | ({"would_write": s["groups"]} if dry_run else {}) for s in stats.values()]
        return found[0] if isinstance(account, str) else found

    def _write_packs(self, records: DataFrame, limits: PackLimits, out_dir: str, stats: dict[str, dict], profile: str | None) -> None:
        now, first = _now(), self._next_id("exports")
        log = {k: (first + i, k, "packs", "raw", out_dir, limits.profile_name, "running", None, None, now, None)
               for i, k in enumerate(stats)}
        self._append("exports", self._rows("exports", list(log.values())))
        placed = packs.assign_packs(records, limits).persist()
        files = packs.pack_files(packs.within_budget(packs.pack_stats(placed), limits.budget), out_dir).persist()
        accounts = self.table("accounts").filter(F.col("account_key").isin(list(stats))).select(
            "account_key", "display_name", "email_address")
        heads = exports.with_headers(files, accounts, now, self.root)
        sinks.write_files(sinks.pack_texts(records, placed, heads), "source_path", "text")
        manifest = exports.pack_manifest(files, accounts, profile, (self.config.get("security") or {}).get(
            "default_export_profile"), now, self.root).orderBy("account_key", "category_path", "source_path")
        rows = [r.asDict() for r in manifest.collect()]  # for each account the source budget and one group more at most
        for key, stat in stats.items():
            own = [r for r in rows if r["account_key"] == key]
            sinks.write_manifest(own, f"{out_dir}/{key}")
            stat |= {"files_written": len(own), "budget_used": len(own), "messages_exported": sum(r["message_count"] for r in own)}
        ids = self.spark.createDataFrame([(k, row[0]) for k, row in log.items()], "account_key string, export_id long")
        done = [(*row[:6], "completed", stats[k]["files_written"], stats[k]["messages_exported"], now, _now()) for k, row in log.items()]
        with self.store.change() as made:
            made.append("export_items", self._shaped("export_items", files.join(ids, "account_key").select(
                "account_key", "export_id", F.col("source_path").alias("output_file"), F.col("category").alias("category_path"))))
            made.replace("exports", state.replace_rows(self.table("exports"), self._rows("exports", done), ["id"]))
        placed.unpersist()
        files.unpersist()

    def export_lines(self, path: str, account: str | None = None, profile: str | None = None) -> dict:
        """Write JSON lines in order of date and the manifest beside them."""
        sources = self.table("mbox_sources").select("source_id", "source_name", "source_slug")
        messages = exports.in_account(self.table("messages"), account).join(sources, "source_id")
        records = exports.jsonl_records(messages, self.table("classifications"), Security.of(self.config), profile).persist()
        size = sinks.write_lines(records, "line", [F.col("date_utc").asc_nulls_last(), F.col("id")], path)
        row = exports.jsonl_stats(records).first().asDict()
        records.unpersist()
        info = self.account(account) if account else None
        entry = dict.fromkeys(exports.MANIFEST, "") | {k: v if v is not None else "" for k, v in row.items()} | {
            "account_key": account or "", "account_display_name": (info or {}).get("display_name") or "",
            "account_email_address": (info or {}).get("email_address") or "", "source_file": Path(path).name,
            "source_path": path, "source_pack": Path(path).name, "byte_count": size, "export_profile": profile or "",
            "security_profile": (self.config.get("security") or {}).get("default_export_profile") or "", "created_at": _now()}
        import json

        manifest = sinks.jsonl_manifest_path(path)
        Path(manifest).write_text(json.dumps([entry], indent=2, ensure_ascii=False), encoding="utf-8")
        return {"written": row["message_count"], "path": path, "manifest": manifest}



