"""Mailbox folders as a stream: new files are parsed, and messages that are not known yet are appended.

A restart continues from the checkpoint; a batch that ran before its commit was lost finds its rows and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.functions.mime import record_columns, with_parsed
from postmill.operators.state import absent
from postmill.sources.mbox import read_mbox

KEYS = ["path", "mbox_key"]


def parsed(raw: DataFrame) -> DataFrame:
    """Records of raw messages (path, mbox_key, raw); broken ones are left out."""
    rows = with_parsed(raw).filter("m.error_type IS NULL")
    return rows.select(*KEYS, *[v.alias(k) for k, v in record_columns().items() if k != "raw_headers"])


def _known(spark: SparkSession, target: str) -> DataFrame:
    """Keys of the rows in the Parquet folder ``target``, if there are any yet."""
    try:
        return spark.read.parquet(target).select(*KEYS)
    except Exception as error:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        return spark.createDataFrame([], "path string, mbox_key long")


def append_absent(spark: SparkSession, rows: DataFrame, target: str) -> None:
    """Append the rows whose keys the Parquet folder ``target`` lacks."""
    absent(_known(spark, target), rows, KEYS).write.mode("append").parquet(target)


def append_mailboxes(spark: SparkSession, raw: DataFrame, target: str) -> None:
    """Append the messages of a few mailboxes that ``target`` lacks.

    Messages are counted by mailbox first: those of a mailbox that is new, or known as a whole, need no join.
    """
    sizes = {r["path"]: r["count"] for r in raw.groupBy("path").count().collect()}
    held = {r["path"]: r["count"] for r in _known(spark, target).filter(
        F.col("path").isin(list(sizes))).distinct().groupBy("path").count().collect()}
    new, some = [p for p in sizes if p not in held], [p for p, n in held.items() if n < sizes[p]]
    if new:
        parsed(raw.filter(F.col("path").isin(new))).write.mode("append").parquet(target)
    if some:
        append_absent(spark, parsed(raw.filter(F.col("path").isin(some))), target)


def ingest_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, files: int = 10) -> StreamingQuery:
    """Start a query that takes up to ``files`` new mailbox files a batch and ends when none is left."""
    # the names alone: without its column "content" this source opens no file
    found = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").option(
        "maxFilesPerTrigger", files).load(folder).select("path")

    def one(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # at most ``files``
        if paths:
            append_mailboxes(spark, read_mbox(spark, paths), target)

    return found.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """A stream without the repetitions of a key that come within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)
