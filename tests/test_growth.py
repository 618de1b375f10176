"""Steps whose cost must follow the input: bodies are not shuffled where their keys are enough."""

from pyspark.sql import functions as F

from postmill.archive import Archive
from postmill.operators import exports, threads
from postmill.plans import catalog
from postmill.sources.mbox import one_file, read_mbox
from postmill.streaming.ingest import append_mailboxes


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def mailbox(path, n):
    path.write_text("".join(f"From x\nSubject: s{i}\n\nbody {i}\n\n" for i in range(n)))
    return str(path)


def test_messages_of_a_mailbox_are_numbered_without_a_shuffle(spark, tmp_path):
    found = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = read_mbox(spark, mailbox(tmp_path / "a.mbox", 300))
        assert rows.rdd.getNumPartitions() > 4
        assert [(r.mbox_key, bytes(r.raw)) for r in rows.orderBy("mbox_key").collect()] == [
            (i, f"Subject: s{i}\n\nbody {i}\n".encode()) for i in range(300)]
        assert "Exchange hashpartitioning" not in plan(rows).split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", found)


def test_parts_are_put_together_in_order(spark, tmp_path):
    spark.range(1000, numPartitions=7).selectExpr("CAST(id AS STRING)").write.text(f"{tmp_path}/parts")
    one_file(spark, f"{tmp_path}/parts", f"{tmp_path}/whole/all.txt")
    assert (tmp_path / "whole/all.txt").read_text().split() == [str(i) for i in range(1000)]
    assert not (tmp_path / "parts").exists()


def test_places_that_are_known_as_a_whole_need_no_join(spark):
    batch = spark.range(10, 20).selectExpr("id AS mbox_key", "'x' AS raw")

    def unknown(*keys):
        known = spark.createDataFrame([(k,) for k in keys], "mbox_key long")
        rows = Archive._unknown(batch, known, 10, 19, 10)
        return sorted(r.mbox_key for r in rows.collect()), "Join" in plan(rows)

    assert unknown(1, 30) == (list(range(10, 20)), False)
    assert unknown(*range(30)) == ([], False)
    assert unknown(10, 12) == ([11, *range(13, 20)], True)


def test_findings_carry_the_account(spark):
    rows = spark.createDataFrame([(1, "me", "a@b.example")], "id long, account_key string, body_text string")
    found = exports.security_findings(rows, "account_key")
    assert [(r.id, r.account_key) for r in found.collect()] == [(1, "me")] and "Join" not in plan(found)


def test_a_stream_adds_the_rest_of_a_mailbox(spark, tmp_path):
    path, target = mailbox(tmp_path / "a.mbox", 5), f"{tmp_path}/out"
    append_mailboxes(spark, read_mbox(spark, path).filter("mbox_key < 2"), target)
    for _ in range(2):
        append_mailboxes(spark, read_mbox(spark, path), target)
    assert sorted(r.mbox_key for r in spark.read.parquet(target).collect()) == list(range(5))


def test_recipients_of_some_orders(spark):
    some = spark.createDataFrame([(1,), (2,)], "_id long")
    every = {r.l_orderkey: r.recipients for r in catalog.recipients(spark, "/root/testdata/sf0.001").collect()}
    found = {r.l_orderkey: r.recipients for r in catalog.recipients(spark, "/root/testdata/sf0.001", some).collect()}
    assert found == {k: v for k, v in every.items() if k in (1, 2)}


def test_threads_are_selected_without_bodies(spark):
    rows = spark.createDataFrame(
        [(1, "me", "t", None, "s", "a@x", ["b@x"], "one"), (2, "me", "u", None, "s", "a@x", ["b@x"], "two")],
        "id long, account_key string, thread_key string, date_utc string, subject string, sender string, recipients array<string>, body_text string")
    seen = []

    def kept(narrow):
        seen.extend(narrow.columns)
        return narrow.filter("thread_key = 'u'")

    found = threads.thread_inputs(rows, ["account_key", "thread_key"], kept).collect()
    assert [(r.thread_key, r.excerpts) for r in found] == [("u", ["two"])] and "body_text" not in seen


def test_few_messages_cross_to_python_at_once(spark):
    """Batches are bounded by rows and by bytes, whatever a task holds."""
    from postmill.functions import mime

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    found = [spark.conf.get(names[0]), spark.conf.get(names[1], str(64 << 20))]
    seen = spark.sparkContext.accumulator(0)

    def sizes(batches):
        for batch in batches:
            raw = batch.column("raw")
            assert len(raw) <= mime.BATCH_ROWS and sum(map(len, raw.to_pylist()[:-1])) <= mime.BATCH_BYTES
            seen.add(len(raw))
            yield batch.select(["raw"])

    try:
        for n, size in ((2000, 10), (40, 1 << 20)):
            rows = spark.range(n, numPartitions=1).select(F.repeat(F.lit("x"), size).cast("binary").alias("raw"))
            assert mime.with_parsed(rows).filter("m.error_type IS NULL").count() == n
            rows.mapInArrow(sizes, "raw binary").count()
        assert seen.value == 2040
    finally:
        for name, value in zip(names, found, strict=True):
            spark.conf.set(name, value)


def test_an_ingest_parses_in_bounded_batches(spark, tmp_path):
    from postmill.functions import mime

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    found = [spark.conf.get(names[0]), spark.conf.get(names[1], str(64 << 20))]
    try:
        for name, value in zip(names, ("10000", str(64 << 20)), strict=True):
            spark.conf.set(name, value)
        archive = Archive(spark, f"{tmp_path}/a")
        archive.initialize()
        assert archive.ingest(mailbox(tmp_path / "a.mbox", 3), "me", create=True)["inserted"] == 3
        assert [spark.conf.get(n) for n in names] == [str(mime.BATCH_ROWS), str(mime.BATCH_BYTES)]
    finally:
        for name, value in zip(names, found, strict=True):
            spark.conf.set(name, value)


def test_long_lines_and_files_cross_in_small_batches_after_short_ones(spark, tmp_path, monkeypatch):
    from postmill import session
    from postmill.sources import sinks

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    found = [spark.conf.get(names[0]), spark.conf.get(names[1], str(64 << 20))]
    each, most, seen = sinks._each_partition, (session.BATCH_ROWS, session.BATCH_BYTES), spark.sparkContext.accumulator(0)

    def checked(batches):
        for batch in batches:
            sizes = [len(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            assert len(sizes) <= most[0] and sum(sizes[:-1]) <= most[1]
            seen.add(len(sizes))
            yield batch

    monkeypatch.setattr(sinks, "_each_partition", lambda rows, run: each(rows, lambda batches: run(checked(batches))))
    try:
        for name, value in zip(names, ("10000", str(64 << 20)), strict=True):
            spark.conf.set(name, value)
        text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("ü"), F.when(F.col("id") < 2000, 1).otherwise(50_000).cast("int")))
        lines = spark.range(2200, numPartitions=3).select("id", text.alias("line"))
        expected = [f"{i}{'ü' * (1 if i < 2000 else 50_000)}" for i in range(2200)]
        size = sinks.write_lines(lines, "line", [F.col("id")], f"{tmp_path}/x.jsonl")
        assert (tmp_path / "x.jsonl").read_bytes() == "".join(x + "\n" for x in expected).encode()
        assert size == (tmp_path / "x.jsonl").stat().st_size
        assert sinks.write_lines(lines.limit(0), "line", [F.col("id")], f"{tmp_path}/none.jsonl") == 0
        files = lines.filter("id > 1900").coalesce(1).select(F.format_string(f"{tmp_path}/f/%s.md", "id").alias("path"), "line")
        sinks.write_files(files, "path", "line")
        assert {int(p.stem): p.read_text("utf-8") for p in (tmp_path / "f").glob("*.md")} == dict(enumerate(expected[1901:], 1901))
        assert seen.value == 2200 + 299
    finally:
        for name, value in zip(names, found, strict=True):
            spark.conf.set(name, value)
