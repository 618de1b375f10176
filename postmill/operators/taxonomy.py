"""Categories, their counts, and proposals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.config import ConfigError
from postmill.functions.text import category_path, display_name, parent_path

CATEGORY_SCHEMA = ("account_key string, path string, display_name string, parent_path string, description string, "
                   "locked boolean, active boolean")


def category_rows(spark: SparkSession, entries: Sequence[dict], account_key: str | None) -> DataFrame:
    """Rows of configured categories: ``path`` and optionally description and locked."""
    given = [(e["path"], e.get("description"), bool(e.get("locked", False))) for e in entries]
    rows = spark.createDataFrame(given, "given string, description string, locked boolean")
    rows = rows.withColumn("path", category_path(F.col("given")))
    return rows.select(
        F.lit(account_key).cast("string").alias("account_key"), "path", display_name(F.col("path")).alias("display_name"),
        parent_path(F.col("path")).alias("parent_path"), "description", "locked", F.lit(True).alias("active"),
    ).dropDuplicates(["account_key", "path"])


def seed(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that ``existing`` lacks; a null account (global) equals a null account."""
    return rows.join(
        existing.select(F.col("path").alias("_p"), F.col("account_key").alias("_a")),
        (F.col("path") == F.col("_p")) & F.col("account_key").eqNullSafe(F.col("_a")), "left_anti")


def visible(categories: DataFrame, account_key: str | None, include_global: bool = True) -> DataFrame:
    """Categories of an account, with the global ones unless told otherwise; of all accounts for None."""
    if account_key is None:
        return categories
    own = F.col("account_key") == account_key
    return categories.filter(own | F.col("account_key").isNull() if include_global else own)


def message_counts(classifications: DataFrame) -> DataFrame:
    """Message-level classifications by category."""
    return classifications.filter("target_type = 'message'").groupBy("category_path").agg(F.count("*").alias("messages"))


def counted(categories: DataFrame, classifications: DataFrame) -> DataFrame:
    """Every category path with its count, 0 when unused."""
    counts = message_counts(classifications)
    return categories.join(counts, F.col("path") == F.col("category_path"), "left").select(
        "path", F.coalesce("messages", F.lit(0)).alias("messages"))


def pending(proposals: DataFrame, account_key: str | None = None) -> DataFrame:
    """Open proposals, the most confident first, then the oldest; nulls last."""
    rows = proposals.filter("status = 'pending'")
    if account_key is not None:
        rows = rows.filter(F.col("account_key") == account_key)
    return rows.orderBy(F.col("confidence").desc_nulls_last(), "created_at")


def decide(proposals: DataFrame, proposal_id: int, approve: bool, note: str = "",
           reviewed_at: str | None = None) -> tuple[DataFrame, str | None]:
    """Proposals after a decision, with its note and time, and the path to add.

    Approving a proposal that is not pending is an error; rejecting one changes nothing.
    """
    found = proposals.filter((F.col("id") == proposal_id) & (F.col("status") == "pending")).select("proposed_path").first()
    if found is None:
        if approve:
            raise ConfigError(f"no pending proposal {proposal_id}")
        return proposals, None
    hit = F.col("id") == proposal_id
    given = {"status": "approved" if approve else "rejected", "reviewed_note": note, "reviewed_at": reviewed_at}
    changed = proposals.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in given.items()})
    return changed, found["proposed_path"] if approve else None
