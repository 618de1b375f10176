"""Thread-level aggregates of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import strip, subject_root
from postmill.session import saved

EXCERPT_CHARS, FIRST_PARTICIPANTS = 500, 20


def in_order(date: str = "date_utc", tie: str = "id") -> Column:
    """Sort key: dates as strings, nulls last, then the id."""
    return F.struct(F.col(date).isNull().alias("undated"), F.col(date).alias("date"), F.col(tie).alias("tie"))


def addresses(sender: str = "sender", recipients: str = "recipients") -> Column:
    """Sender and recipients in one array, the sender only if present."""
    one = F.when(F.coalesce(F.col(sender), F.lit("")) != "", F.array(sender)).otherwise(F.array().cast("array<string>"))
    return F.concat(one, F.coalesce(F.col(recipients), F.array().cast("array<string>")))


def thread_table(messages: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """message_count, date_min, date_max over each thread; subject and participants of its first message."""
    return messages.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("message_count"), F.min("date_utc").alias("date_min"), F.max("date_utc").alias("date_max"),
        F.min_by("subject", order).alias("subject"),
        F.min_by(F.slice(addresses(), 1, FIRST_PARTICIPANTS), order).alias("participants"))


def day_of(date: str = "date_utc") -> Column:
    """Label that sorts like dates do by day, nulls last."""
    return F.coalesce(F.concat(F.lit("0"), F.substring(date, 1, 10)), F.lit("1"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], part: Column) -> DataFrame:
    """``rows`` with _rank (from 1) and _count within ``keys``, in ``order``.

    ``part`` must sort like a beginning of ``order``.  Each part of a group is a window of its own and the counts of
    earlier parts are added, so no task sorts a whole hot group.
    """
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys)
    earlier = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("_count"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        rows.withColumn("_own", F.row_number().over(own)).join(offsets, same)
        .withColumn("_rank", F.col("_own") + F.col("_before"))
        .drop("_part", "_p", "_own", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def excerpt_places(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, _rank) of up to four rows of each group, in order: first, middle, third quarter (of more than four), last."""
    n, r = F.col("_count"), F.col("_rank")
    pick = (
        (r == 1) | (r == n) | ((n > 2) & (r == F.floor(n / 2) + 1)) | ((n > 4) & (r == F.floor(3 * n / 4) + 1)))
    order = [F.col("date_utc").asc_nulls_last(), F.col("id")]
    return ranked(bodies.select(*keys, "id", "date_utc"), keys, order, day_of()).filter(pick).select(*keys, "id", "_rank")


def has_body() -> Column:
    return F.coalesce(strip(F.col("body_text")) != "", F.lit(False))


def _excerpted(places: DataFrame, messages: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Bodies of the places, trimmed and cut, in order: the few rows are looked up, the others never leave their table."""
    own = places.select("id", "_rank", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    cut = messages.select("id", *keys, F.substring(strip(F.col("body_text")), 1, max_chars).alias("body"))
    same = cut["id"] == own["id"]
    for i, k in enumerate(keys):
        same = same & cut[k].eqNullSafe(own[f"_k{i}"])
    found = cut.join(own, same).select(*[cut[k] for k in keys], "_rank", "body")
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "body"))).alias("_e")).select(
        *keys, F.transform("_e", lambda e: e["body"]).alias("excerpts"))


def excerpts(messages: DataFrame, keys: list[str], max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """Up to four bodies of each group (see :func:`excerpt_places`).

    Only non-blank bodies count; they are trimmed and cut.  Groups without one are not in the result.
    """
    return _excerpted(excerpt_places(messages.filter(has_body()), keys), messages, keys, max_chars)


def thread_inputs(messages: DataFrame, keys: list[str], kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a thread for the rules: subject, sender, participants, recipients, counts, dates, excerpts.

    The subject is the first non-blank one without reply marks; the sender the first message's; participants are
    all distinct lower-case addresses, sorted, and recipients those without the sender.  Rows with a null thread
    key (the last of ``keys``) have no thread.  ``kept`` selects whole threads, from rows without bodies.
    """
    rows = messages.filter(F.col(keys[-1]).isNotNull())
    # without bodies; written once, since ranks, addresses and the other columns are aggregated side by side
    narrow = rows.select(*keys, "id", "date_utc", "subject", "sender", "recipients", has_body().alias("_has_body"))
    narrow = saved(kept(narrow) if kept else narrow)
    order = in_order()
    blank = strip(F.coalesce(F.col("subject"), F.lit(""))) == ""
    base = narrow.groupBy(*keys).agg(
        F.coalesce(F.min_by(subject_root(F.col("subject")), F.when(~blank, order)), F.lit("")).alias("subject"),
        F.coalesce(F.min_by("sender", order), F.lit("")).alias("sender"),
        F.count("*").alias("message_count"), F.min(F.nullif("date_utc", F.lit(""))).alias("date_min"),
        F.max(F.nullif("date_utc", F.lit(""))).alias("date_max"))
    people = narrow.select(*keys, F.explode(F.transform(addresses(), F.lower)).alias("_a")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("_a")).alias("participants"))
    found = _excerpted(excerpt_places(narrow.filter("_has_body"), keys), rows, keys, EXCERPT_CHARS)
    for other in (people, found):
        (column,) = [c for c in other.columns if c not in keys]
        given = other.select(column, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        base = base.join(given, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    none = F.array().cast("array<string>")
    base = base.withColumns({c: F.coalesce(c, none) for c in ("participants", "excerpts")})
    return base.withColumn("recipients", F.array_remove("participants", F.lower("sender")))
