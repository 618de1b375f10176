"""Export: which records go out, how they are packed under limits, and what each pack holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.privacy import Security, apply_policy, export_profile
from postmill.functions.text import (
    category_directory,
    category_path,
    date_band,
    filled,
    pack_filename,
    render_message,
    word_count,
)
from postmill.limits import PackLimits
from postmill.operators.threads import day_of, ranked
from postmill.session import saved

GROUP = ["account_key", "category", "band"]
#: What the statistics of packs need of a record; it travels through the packing, so records are rendered once.
CARRIED = ["thread_key", "date_utc", "was_scrubbed", "chunk_words", "chunk_bytes"]
#: Rows of a group that one task packs, at least, and chunks of a group, at most: larger groups have larger chunks, so
#: the tables that link them stay small.
CHUNK, MOST_CHUNKS = 200_000, 2_000


def classified(messages: DataFrame, classifications: DataFrame) -> DataFrame:
    """Messages with each of their message-level classifications: one row a pair."""
    rows = classifications.filter("target_type = 'message'").select(
        F.col("message_db_id").alias("id"), "category_path", "export_profile", "sensitivity")
    return messages.join(rows, "id")


def unclassified(messages: DataFrame, classifications: DataFrame) -> DataFrame:
    """Messages without any message-level classification, as category ``unclassified``."""
    done = classifications.filter("target_type = 'message'").select(F.col("message_db_id").alias("id"))
    none = F.lit(None).cast("string")
    return messages.join(done, "id", "left_anti").select(
        "*", F.lit("unclassified").alias("category_path"), none.alias("export_profile"), none.alias("sensitivity"))


def first_classification(classifications: DataFrame) -> DataFrame:
    """The message-level classification with the smallest id of each message."""
    rows = classifications.filter("target_type = 'message'")
    kept = [c for c in rows.columns if c != "message_db_id"]
    return rows.groupBy("message_db_id").agg(F.min_by(F.struct(*kept), "id").alias("_c")).select("message_db_id", "_c.*")


def export_records(messages: DataFrame, classifications: DataFrame, security: Security,
                   override: str | None = None) -> DataFrame:
    """Records that may go out, classified ones first (``_source`` 0, then 1), bodies as their policy wants them.

    ``override`` goes before the record's profile, which goes before the configured default.  ``was_scrubbed`` tells
    whether redaction changed the body.
    """
    rows = classifications.filter("target_type = 'message'").select(
        F.col("message_db_id").alias("id"), "category_path", "export_profile", "sensitivity", F.lit(0).alias("_source"))
    # an outer join is the union of the classified and the unclassified rows, and reads the messages once
    both = messages.join(rows, "id", "left").withColumns({
        "category_path": F.when(F.col("_source").isNull(), "unclassified").otherwise(F.col("category_path")),
        "_source": F.coalesce("_source", F.lit(1))})
    profile = F.lit(override) if override else export_profile(F.col("export_profile"), security.default_export_profile)
    rows = both.withColumn("effective_profile", profile).filter("effective_profile <> 'exclude'")
    body, changed = apply_policy(F.col("body_text"), F.col("effective_profile"), security)
    return rows.withColumns({"was_scrubbed": changed, "body_text": body})


def with_chunks(records: DataFrame) -> DataFrame:
    """Records with category, band, the rendered chunk and its words and bytes."""
    return records.withColumns({
        "category": category_path(F.coalesce(filled(F.col("category_path")), F.lit("unclassified"))),
        "band": date_band(F.col("date_utc")),
        "chunk": render_message(*[F.col(c) for c in ("subject", "sender", "date_utc", "message_id", "body_text")]),
    }).withColumns({
        "chunk_words": word_count(F.col("chunk")).cast("long"),
        "chunk_bytes": F.octet_length("chunk").cast("long"),
    })


def next_starts(words: np.ndarray, sizes: np.ndarray, limits: PackLimits) -> np.ndarray:
    """For each row: where the next pack starts if a pack starts at this row (the length when none does)."""
    n = len(words)
    i = np.arange(n)
    out = np.minimum(i + limits.max_messages_per_source, n)
    for values, most, target in (
        (words, limits.max_words_per_source, limits.target_words_per_source),
        (sizes, limits.max_bytes_per_source, limits.target_bytes_per_source),
    ):
        total = np.concatenate(([0], np.cumsum(values)))
        over = np.searchsorted(total, total[:-1] + most, side="right") - 1  # first row that does not fit
        full = np.searchsorted(total, total[:-1] + target, side="left")  # first row after the target is met
        out = np.minimum(out, np.minimum(over, full))
    return np.clip(out, i + 1, n)


def assign_packs(rows: DataFrame, limits: PackLimits, chunk: int = CHUNK) -> DataFrame:
    """(_source, id, category_path, account_key, category, band, pack and ``CARRIED``): the greedy packing of each group.

    A pack closes before a record that would take it over a maximum, or once it has reached a target.  A group's rows
    are cut into chunks that are packed side by side: every chunk works out, for each place where a pack may enter it,
    where the packs leave it; one pass over these small tables links the chunks; then each assigns its packs.
    """
    chunk = max(chunk, 2 * min(limits.max_messages_per_source, 1 << 20))
    reach = min(limits.max_messages_per_source, chunk)
    order = [F.col("_source"), F.col("category_path"), F.col("date_utc").asc_nulls_last(), F.col("id")]
    part = F.struct("_source", "category_path", day_of().alias("day"))
    # rendering and redaction run once, for these narrow rows, however often they are read below
    narrow = saved(rows.select("_source", "id", "category_path", *GROUP, *CARRIED))
    at, size = F.col("_rank") - 1, F.greatest(F.lit(chunk), F.ceil(F.col("_count") / MOST_CHUNKS))
    placed = saved(ranked(narrow, GROUP, order, part).select(
        "_source", "id", "category_path", *GROUP, *CARRIED, at.alias("at"), F.floor(at / size).alias("part"),
        (at % size < reach).alias("_near")))
    near = (F.col("part") > 0) & F.col("_near")
    dealt = placed.withColumn("task", F.explode(F.when(
        near, F.array("part", F.col("part") - 1)).otherwise(F.array("part"))))

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        task = int(pdf["task"].iloc[0])
        own = int((pdf["part"] == task).sum())
        jump = next_starts(pdf["chunk_words"].to_numpy(), pdf["chunk_bytes"].to_numpy(), limits)
        leave, packs = np.zeros(own, np.int64), np.zeros(own, np.int64)
        for i in range(own - 1, -1, -1):
            j = int(jump[i])
            leave[i], packs[i] = (j - own, 1) if j >= own else (leave[j], packs[j] + 1)
        k = min(own, reach + 1) if task else 1
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in GROUP}, "task": [task], "own": [own],
                             "leave": [leave[:k]], "packs": [packs[:k]]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        enter, first, out = 0, 1, []
        for row in pdf.sort_values("task").itertuples():
            out.append((row.task, enter, first))
            if enter >= row.own:
                enter -= row.own
            else:
                first += int(row.packs[enter])
                enter = int(row.leave[enter])
        found = pd.DataFrame(out, columns=["task", "enter", "first"])
        for g in GROUP:
            found[g] = pdf[g].iloc[0]
        return found

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        own = int((pdf["part"] == pdf["task"]).sum())
        jump = next_starts(pdf["chunk_words"].to_numpy(), pdf["chunk_bytes"].to_numpy(), limits)
        i, seq = int(pdf["enter"].iloc[0]), int(pdf["first"].iloc[0])
        packs = np.full(own, seq - 1, np.int64)
        while i < own:
            j = min(int(jump[i]), own)
            packs[i:j] = seq
            i, seq = j, seq + 1
        kept = pdf.iloc[:own][["_source", "id", "category_path", *GROUP, *CARRIED]].copy()
        kept["pack"] = packs
        return kept

    kinds = dict(narrow.dtypes)
    groups = ", ".join(f"{g} {kinds[g]}" for g in GROUP)
    paths = dealt.groupBy(*GROUP, "task").applyInPandas(
        ways, f"{groups}, task long, own long, leave array<long>, packs array<long>")
    entries = paths.groupBy(*GROUP).applyInPandas(link, f"{groups}, task long, enter long, first long")
    return dealt.join(entries, [*GROUP, "task"]).groupBy(*GROUP, "task").applyInPandas(
        assign, f"_source {kinds['_source']}, id {kinds['id']}, category_path string, {groups}, "
                + "".join(f"{c} {kinds[c]}, " for c in CARRIED) + "pack long")


def pack_stats(packs: DataFrame) -> DataFrame:
    """messages, threads, words, chunk bytes, dates and the scrub flag of each pack of :func:`assign_packs`.

    Thread keys are counted in two steps, so a hot pack or thread is combined before it is shuffled.
    """
    rows = packs
    threads = F.nullif("thread_key", F.lit(""))
    dates = F.nullif("date_utc", F.lit(""))
    return rows.groupBy(*GROUP, "pack").agg(
        F.count("*").alias("message_count"), F.count_distinct(threads).alias("thread_count"),
        F.sum("chunk_words").alias("word_count"),
        (F.sum("chunk_bytes") + F.count("*") - 1).alias("body_bytes"), F.min(dates).alias("date_min"),
        F.max(dates).alias("date_max"), F.bool_or("was_scrubbed").alias("contains_scrubbed_content"))


def within_budget(stats: DataFrame, budget: int) -> DataFrame:
    """Packs of the groups that start before ``budget`` packs exist, groups in order; a started group is finished.

    Group sizes are summed first; the running sum goes over one row a group of an account.
    """
    sizes = stats.groupBy(*GROUP).agg(F.max("pack").alias("_packs"))
    before = Window.partitionBy("account_key").orderBy("category", "band").rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.withColumn("_before", F.coalesce(F.sum("_packs").over(before), F.lit(0))).filter(
        F.col("_before") < budget)
    return stats.join(kept.select(*GROUP), GROUP, "left_semi")


def pack_files(stats: DataFrame, out_dir: str) -> DataFrame:
    """``stats`` with source_file and source_path."""
    name = pack_filename(F.col("category"), F.col("band"), F.col("pack"))
    folder = category_directory(F.concat_ws("/", F.lit(out_dir), "account_key"), F.col("category"), F.col("band"))
    return stats.withColumn("source_file", name).withColumn("source_path", F.concat_ws("/", folder, "source_file"))
