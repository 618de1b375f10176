"""Mailbox files as a relation.

The text reader cuts files at lines that begin with ``From ``, in parallel and on any file system Spark reads, so
there is no table of contents to build on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = "\nFrom "


def numbered_lines(spark: SparkSession, paths: str | list[str], separator: str = "\n") -> DataFrame:
    """path, value, _rank (from 1) and _count of the pieces of each file, and _head, the first five characters of its first.

    A first pass counts the pieces of each split; there is a row a split of these counts, so they are broadcast, and the
    pieces themselves are never shuffled.  A piece's place in its split is that in its task less that of the split's first.
    """
    rows = spark.read.option("lineSep", separator).text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_m"))
    splits = rows.groupBy("path", "_block").agg(
        F.min("_m").alias("_first"), F.count("*").alias("_n"), F.min_by(F.substring("value", 1, 5), "_m").alias("_begin"))
    over = Window.partitionBy("path")
    places = splits.select(
        F.col("path").alias("_p"), F.col("_block").alias("_b"), "_first", "_n", F.sum("_n").over(over).alias("_count"),
        F.coalesce(F.sum("_n").over(over.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.min_by("_begin", "_block").over(over).alias("_head"))
    own = F.col("_m") - F.col("_first")
    # both passes cut the same files alike; if they ever did not, no place would be right
    place = F.when(own.between(0, F.col("_n") - 1), own + F.col("_before") + 1).otherwise(
        F.raise_error(F.lit("the splits of a file have changed while it was read")).cast("long"))
    found = rows.join(F.broadcast(places), (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")), "left")
    return found.select("path", "value", place.alias("_rank"), "_count", "_head")


def read_mbox(spark: SparkSession, paths: str | list[str], after: int | None = None) -> DataFrame:
    """path, mbox_key (0, 1, ... in each file), raw (bytes of the message without its ``From`` line).

    ``after`` leaves out keys up to and including it, as a resumed ingest does.  Text before the first ``From`` line
    is no message.
    """
    numbered = numbered_lines(spark, paths, SEPARATOR).withColumn("_lead", F.when(F.startswith("_head", F.lit("From ")), 0).otherwise(1))
    body = F.substring(F.col("value"), F.instr("value", "\n") + 1, F.length("value"))
    body = F.when(F.contains("value", F.lit("\n")), body).otherwise(F.lit(""))
    ended = F.endswith(body, F.lit("\n"))
    last = F.col("_rank") == F.col("_count")
    # the separator took the blank line before "From", or the end of a line when there was none
    fixed = (
        F.when(~last & ~ended & (body != ""), F.concat(body, F.lit("\n")))
        .when(last & F.endswith(body, F.lit("\n\n")), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body))
    out = numbered.filter(F.col("_rank") > F.col("_lead")).select(
        "path", (F.col("_rank") - 1 - F.col("_lead")).cast("long").alias("mbox_key"), fixed.cast("binary").alias("raw"))
    return out if after is None else out.filter(F.col("mbox_key") > after)


def write_mbox(messages: DataFrame, path: str) -> None:
    """Write message_id, sender, recipients, subject, date_header, body_text as mailbox files of one folder.

    Subjects go out as encoded words, bodies as 8-bit UTF-8; lines that begin with ``From `` get a ``>``.
    """
    def line(name: str, value) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))

    subject = F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode("subject", "utf-8")), F.lit("?="))
    body = F.regexp_replace(F.coalesce("body_text", F.lit("")), "(?m)^From ", ">From ")
    text = F.concat_ws(
        "\n", F.lit("From postmill Thu Jan  1 00:00:00 1970"), line("From", F.col("sender")),
        line("To", F.array_join("recipients", ", ")), line("Subject", F.regexp_replace(subject, "[\r\n]", "")),
        line("Date", F.col("date_header")), line("Message-ID", F.concat(F.lit("<"), "message_id", F.lit(">"))),
        line("References", F.col("references")), F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: 8bit"), F.lit(""), body, F.lit(""))
    messages.select(text.alias("value")).write.mode("overwrite").text(path)


def one_file(spark: SparkSession, folder: str, target: str) -> None:
    """Put the part files of a folder together, in order of name, and delete the folder.

    The bytes run through the driver as a stream, on any file system; no part is held.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    parts, whole = hadoop.fs.Path(folder), hadoop.fs.Path(target)
    fs = parts.getFileSystem(conf)
    found = sorted((s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = whole.getFileSystem(conf).create(whole)
    try:
        for part in found:
            stream = fs.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
    fs.delete(parts, True)


def file_facts(spark: SparkSession, path: str) -> dict:
    """size (bytes), modified (milliseconds) and sha256 of one file of any size, on any file system.

    The bytes run through the digest as a stream; no part of the file is held.  A folder has no digest.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"no mailbox at {path}")
    status, digest = fs.getFileStatus(where), None
    if status.isFile():
        stream = fs.open(where)
        try:
            digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
    return {"size": fs.getContentSummary(where).getLength(), "modified": status.getModificationTime(), "sha256": digest}
