"""Message-level and thread-level rule classification, and inheritance from threads to messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.rules import Rule, first_match
from postmill.operators.threads import thread_inputs

RULE_TYPES = ("rule", "rule_hint")
VERSION = "rules-v1"


def without_rule_rows(messages: DataFrame, classifications: DataFrame) -> DataFrame:
    """Messages that no rule or hint has classified; inherited rows do not count."""
    done = classifications.filter(
        (F.col("target_type") == "message") & F.col("classifier_type").isin(*RULE_TYPES))
    return messages.join(done.select(F.col("message_db_id").alias("id")), "id", "left_anti")


def _threads_with_rule_rows(classifications: DataFrame) -> DataFrame:
    return classifications.filter(
        (F.col("target_type") == "thread") & F.col("classifier_type").isin(*RULE_TYPES)
    ).select(F.col("account_key").alias("_a"), F.col("thread_key").alias("_t")).distinct()


def threads_without_rule_rows(messages: DataFrame, classifications: DataFrame, by_account: bool = True) -> DataFrame:
    """Distinct (account_key, thread_key) that have no thread-level rule row; accounts compare null-safely.

    Without ``by_account`` a rule row of any account counts, and the distinct thread keys are given.
    """
    keys = ["account_key", "thread_key"] if by_account else ["thread_key"]
    threads = messages.filter("thread_key IS NOT NULL").select(*keys).distinct()
    done = _threads_with_rule_rows(classifications)
    same = threads["thread_key"] == done["_t"]
    return threads.join(done, same & threads["account_key"].eqNullSafe(done["_a"]) if by_account else same, "left_anti")


def matched(records: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``records`` with ``outcome``: what the first matching rule gives, null when none does."""
    return records.withColumn("outcome", first_match(rules, F.col("sender"), F.col("recipients"), F.col("subject")))


def counters(records: DataFrame) -> DataFrame:
    """classified and skipped of a matched relation; a rule without category counts as classified."""
    return records.agg(
        F.count_if(F.col("outcome").isNotNull()).alias("classified"),
        F.count_if(F.col("outcome").isNull()).alias("skipped"))


def message_rows(records: DataFrame) -> DataFrame:
    """Classification rows of matched messages; nothing is stored without a category."""
    return records.filter("outcome.category_path IS NOT NULL").select(
        "account_key", F.lit("message").alias("target_type"), F.col("id").alias("message_db_id"), "thread_key",
        "outcome.category_path", "outcome.sensitivity", "outcome.notebooklm_priority", "outcome.export_profile",
        "outcome.classifier_type", F.col("outcome.rule").alias("classifier_name"), "outcome.confidence")


def classify_messages(messages: DataFrame, classifications: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """New rows for the messages that have no rule row yet."""
    if not rules:
        return message_rows(matched(messages.limit(0), rules))
    return message_rows(matched(without_rule_rows(messages, classifications), rules))


def match_threads(messages: DataFrame, classifications: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Thread inputs of the open threads with their outcome."""
    done = _threads_with_rule_rows(classifications)

    def is_open(rows: DataFrame) -> DataFrame:
        return rows.join(done, rows["account_key"].eqNullSafe(done["_a"]) & (rows["thread_key"] == done["_t"]), "left_anti")

    return matched(thread_inputs(messages, ["account_key", "thread_key"], is_open), rules)


def thread_rows(threads: DataFrame) -> DataFrame:
    """Thread-level classification rows with their evidence as JSON."""
    evidence = F.to_json(
        F.struct("participants", "date_min", "date_max", "message_count", "excerpts"), {"ignoreNullFields": "false"})
    return threads.filter("outcome.category_path IS NOT NULL").select(
        "account_key", F.lit("thread").alias("target_type"), "thread_key", "outcome.category_path",
        "outcome.sensitivity", "outcome.notebooklm_priority", "outcome.export_profile", "outcome.classifier_type",
        F.col("outcome.rule").alias("classifier_name"), "outcome.confidence", F.lit(VERSION).alias("prompt_version"),
        F.concat(F.lit("Thread classified by rule: "), "outcome.rule").alias("summary"), evidence.alias("raw_output_json"))


def inherited_rows(messages: DataFrame, classifications: DataFrame, threads: DataFrame) -> DataFrame:
    """Message rows that threads pass on.

    A message keeps its own classification if its best rule confidence reaches the thread's, and inherits once only.
    """
    own = classifications.filter("message_db_id IS NOT NULL").groupBy("message_db_id", "account_key").agg(
        F.max(F.when(F.col("classifier_type").isin(*RULE_TYPES), F.col("confidence"))).alias("best"),
        F.bool_or(F.col("classifier_type") == "rule_inherited").alias("has_inherited"))
    own = own.select(F.col("message_db_id").alias("_m"), F.col("account_key").alias("_o"), "best", "has_inherited")
    given = threads.filter("outcome.category_path IS NOT NULL").select(
        F.col("account_key").alias("_a"), F.col("thread_key").alias("_t"), "outcome")
    rows = messages.select("id", "account_key", "thread_key").join(
        given, F.col("account_key").eqNullSafe(F.col("_a")) & (F.col("thread_key") == F.col("_t")))
    rows = rows.join(own, (F.col("id") == F.col("_m")) & F.col("account_key").eqNullSafe(F.col("_o")), "left")
    return rows.filter(
        (F.col("best").isNull() | (F.col("best") < F.col("outcome.confidence")))
        & ~F.coalesce("has_inherited", F.lit(False))
    ).select(
        "account_key", F.lit("message").alias("target_type"), F.col("id").alias("message_db_id"), "thread_key",
        "outcome.category_path", "outcome.sensitivity", "outcome.notebooklm_priority", "outcome.export_profile",
        F.lit("rule_inherited").alias("classifier_type"), F.col("outcome.rule").alias("classifier_name"),
        "outcome.confidence", F.lit(VERSION).alias("prompt_version"))
