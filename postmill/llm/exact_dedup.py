"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is cut at places that its own characters decide (a sentence end or line break once a chunk has
``MIN_CHUNK`` characters, at the latest after ``MAX_CHUNK``), so equal texts have equal chunks.  A chunk gets a
64-bit identifier; one pass over the distinct chunk contents verifies that no identifier stands for two contents.
Documents are then compared by their ordered identifier lists (recipes), which are some hundred times smaller
than the texts: texts cross the network once, as distinct chunks, and never as whole documents.
If the verification finds identifiers with several contents, these get an ordinal as second part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import saved, span_of

MIN_CHUNK, MAX_CHUNK = 256, 4096
CHUNKS = rf"(?s)(?:.{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:[.!?]\s|\n)|.{{1,{MAX_CHUNK}}})"


def _identifier(chunk, bits: int):
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def chunk_recipes(docs: DataFrame, text: str = "text", id_bits: int = 64) -> DataFrame:
    """(doc_id, rid, text_sha256, recipe): one row per input row; rid tells repeated rows apart.

    ``id_bits`` under 64 weakens the identifiers; tests use it to reach the verification's second way.
    """
    body = span_of(F.col(text))
    base = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("rid"),
        F.sha2(body.cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all(body, F.lit(CHUNKS), F.lit(0)).alias("chunks"),
    )
    recipes = saved(base.select(
        "doc_id", "rid", "text_sha256",
        F.transform("chunks", lambda c: _identifier(c, id_bits)).alias("recipe"),
    ))
    contents = (
        docs.select(F.explode(F.regexp_extract_all(body, F.lit(CHUNKS), F.lit(0))).alias("chunk"))
        .select(_identifier(F.col("chunk"), id_bits).alias("h"), "chunk")
        .groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    )
    shared = contents.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    if not shared.take(1):
        return recipes
    order = contents.join(shared, "h", "left_semi").groupBy("h").agg(
        F.array_sort(F.collect_list("chunk")).alias("contents"))
    parts = (
        base.select("doc_id", "rid", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk"))
        .withColumn("h", _identifier(F.col("chunk"), id_bits))
        .join(order, "h", "left")
        .withColumn("k", F.coalesce(F.array_position("contents", F.col("chunk")), F.lit(0)))
        .groupBy("rid", "doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "h", "k"))).alias("parts"))
    )
    flat = F.flatten(F.transform(F.filter("parts", lambda p: p["pos"].isNotNull()),
                                 lambda p: F.array(p["h"], p["k"])))
    return saved(parts.select("doc_id", "rid", "text_sha256", flat.alias("recipe")))


def exact_duplicates(docs: DataFrame, text: str = "text", id_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null text counts as empty, and all empty texts are equal.  Of equal texts the row with the largest doc_id
    stays; a null doc_id is smaller than any other.  Of rows that repeat both doc_id and text, exactly one is
    kept.  An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    recipes = chunk_recipes(docs, text, id_bits)
    # written, so that the join has plain exchanges on both sides and can split a large group of copies
    best = saved(recipes.groupBy("recipe").agg(
        F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")))
    return (
        recipes.join(best, "recipe")
        .select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
            (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "rid",
        )
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, all columns, one row of each group.

    Null and empty texts are one group; a null doc_id is smaller than any other; of rows that are equal in both, any
    one stays.  An empty table gives an empty result.
    """
    from pyspark.sql import Window

    kept = exact_duplicates(docs, text).filter("kept").select(_row_key(F.col("text_sha256")).alias("_key"))
    own = docs.withColumn("_key", _row_key(F.sha2(span_of(F.col(text)).cast("binary"), 256)))
    stay = own.join(kept, "_key", "left_semi")
    first = Window.partitionBy("_key").orderBy(F.lit(1))  # as the join is partitioned: no exchange
    return stay.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*docs.columns)


def _row_key(sha):
    """One column for a doc_id and the hash of a text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)
