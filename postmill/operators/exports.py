"""Projections that feed the writers: JSON lines, findings, labels, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.privacy import Security, apply_policy, export_profile, findings
from postmill.functions.text import body_hash, label_name, pack_header, slug, word_count
from postmill.operators.packs import first_classification

#: Manifest columns in order.
MANIFEST = ("account_key", "account_display_name", "account_email_address", "source_file", "source_path", "category_path",
            "source_pack", "message_count", "thread_count", "date_min", "date_max", "word_count", "byte_count",
            "export_profile", "security_profile", "contains_scrubbed_content", "created_at")
#: Keys of a JSON line in order; classification follows for classified messages.
JSONL = ("id", "message_id", "thread_key", "subject", "sender", "date_utc", "body_text", "body_hash", "body_chars",
         "body_word_count", "attachment_count", "source_name", "source_slug", "account_key", "recipients", "cc")
CLASSIFICATION = ("category_path", "sensitivity", "export_profile", "confidence", "classifier_type")


def in_account(rows: DataFrame, account_key: str | None) -> DataFrame:
    """Rows of one account; all for None."""
    return rows if account_key is None else rows.filter(F.col("account_key") == account_key)


def with_source(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Rows with their source's columns; the small side is left to the optimizer's size check."""
    return rows.join(sources, key)


def label_dictionary(rows: DataFrame) -> DataFrame:
    """Distinct (account_key, label) of rows with an array of raw labels."""
    return rows.select("account_key", F.explode("labels").alias("_l")).select(
        "account_key", label_name(F.col("_l")).alias("label")).distinct()


def security_findings(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each finding type of each body (id, ``more``, finding_type, severity, detector, excerpt, count)."""
    return rows.filter("body_text IS NOT NULL").select("id", *more, F.inline(findings(F.col("body_text"))))


def with_metrics(messages: DataFrame) -> DataFrame:
    """Messages with the columns that ingest computes, for relations that lack them."""
    body = F.col("body_text")
    added = {
        "body_hash": body_hash(body), "body_chars": F.coalesce(F.length(body), F.lit(0)),
        "body_word_count": word_count(body), "attachment_count": F.lit(0), "source_slug": slug(F.col("source_name")),
        "cc": F.array().cast("array<string>"),
    }
    return messages.withColumns({k: v for k, v in added.items() if k not in messages.columns})


def jsonl_records(messages: DataFrame, classifications: DataFrame, security: Security,
                  override: str | None = None) -> DataFrame:
    """id, line and the columns of the statistics for every message that may go out.

    A message carries its first classification only.  Metadata-only records lose body and word count; the
    classification key is missing, not null, for unclassified messages.
    """
    first = first_classification(classifications).select(
        "message_db_id", F.struct(*[c for c in CLASSIFICATION]).alias("classification"))
    rows = messages.join(first, messages["id"] == first["message_db_id"], "left")
    profile = F.lit(override) if override else export_profile(
        F.col("classification.export_profile"), security.default_export_profile)
    rows = rows.withColumn("effective_profile", profile).filter("effective_profile <> 'exclude'")
    body, changed = apply_policy(F.col("body_text"), F.col("effective_profile"), security)
    words = F.when(F.col("effective_profile") != "metadata-only", F.col("body_word_count"))
    rows = rows.withColumns({"was_scrubbed": changed, "body_word_count": words, "body_text": body})
    keep = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*JSONL), keep)
    tagged = F.to_json(F.struct(*JSONL, "classification"), keep)
    return rows.select("id", "account_key", "thread_key", "date_utc", "body_word_count", "was_scrubbed",
                       F.when(F.col("classification").isNull(), plain).otherwise(tagged).alias("line"))


def jsonl_stats(records: DataFrame) -> DataFrame:
    """One row: messages, threads, dates, words (null counts 0) and the scrub flag."""
    dates = F.nullif("date_utc", F.lit(""))
    return records.agg(
        F.count("*").alias("message_count"), F.count_distinct(F.nullif("thread_key", F.lit(""))).alias("thread_count"),
        F.min(dates).alias("date_min"), F.max(dates).alias("date_max"),
        F.coalesce(F.sum("body_word_count"), F.lit(0)).cast("long").alias("word_count"),
        F.coalesce(F.bool_or("was_scrubbed"), F.lit(False)).alias("contains_scrubbed_content"))


def with_headers(files: DataFrame, accounts: DataFrame, exported_at: str, origin: str) -> DataFrame:
    """Packs with their account's names and the head of the file."""
    named = files.join(accounts.select("account_key", "display_name", "email_address"), "account_key", "left")
    return named.withColumn("header", pack_header(
        F.col("account_key"), F.col("email_address"), F.col("category"), F.col("band"), F.col("pack"),
        F.col("message_count"), F.lit(exported_at), F.lit(origin)))


def pack_manifest(files: DataFrame, accounts: DataFrame, export_profile: str | None, security_profile: str | None,
                  created_at: str, origin: str) -> DataFrame:
    """Manifest rows of packs; nulls become empty strings, bytes are those of the file with its head."""
    rows = with_headers(files, accounts, created_at, origin)
    named = {
        "account_display_name": F.coalesce("display_name", F.lit("")),
        "account_email_address": F.coalesce("email_address", F.lit("")),
        "category_path": F.col("category"), "source_pack": F.col("source_file"),
        "date_min": F.coalesce("date_min", F.lit("")), "date_max": F.coalesce("date_max", F.lit("")),
        "byte_count": F.col("body_bytes") + F.octet_length("header"),
        "export_profile": F.lit(export_profile or ""), "security_profile": F.lit(security_profile or ""),
        "created_at": F.lit(created_at),
    }
    return rows.withColumns(named).select(*MANIFEST)
