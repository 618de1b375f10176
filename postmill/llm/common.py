"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; with documents of a few kB this keeps a batch at a few MB.
ARROW_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that cross to a Python worker at once (texts can be long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder.

    The cluster names it in spark.checkpoint.dir; only on a local master where that is unset, as in tests, a
    temporary one is used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column | str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(col.cast("string").cast("binary")) % folds


def span_of(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` (whole text, label) pairs of each class, ordered by doc_id.

    The labelled ids with the smallest hashes are chosen, so the sample does not depend on partitions; null labels,
    ids and texts are not used, and of several texts of one doc_id the smallest is.  The bound is the caller's
    parameter: what reaches the driver does not grow with the tables.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter("y in (0, 1)").distinct()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return []
    known = known.withColumn("_h", F.xxhash64("doc_id"))
    place = F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30)
    chosen = None
    for y, n in sorted(sizes.items()):  # the first test only spares the sort most rows
        few = known.filter((F.col("y") == y) & (place < min(1.0, 2 * rows / n + 1e-4))).orderBy(place, "_h").limit(rows)
        chosen = few if chosen is None else chosen.unionByName(few)
    found = (
        docs.select("doc_id", "text").filter("text is not null")
        .join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")  # at most 2 * rows rows
        .groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    )
    return [(r["text"], r["y"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["y"]))]


def map_texts(docs: DataFrame, keep: list[str], schema: str, make, group_chars: int = 0) -> DataFrame:
    """Columns ``keep`` of every row, then those of ``schema`` that a scorer computes from the text.

    ``make()`` runs once a task and returns a function from a list of texts (with None) to lists of values,
    one for each column of ``schema``.
    Arrow batches are put together until their texts have ``group_chars`` characters.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    given = docs.select(*keep, F.col("text").alias("_text"))
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches):
        score = make()

        def scored(held):
            columns = score([t for _, texts in held for t in texts])
            at = 0
            for batch, texts in held:
                own = [pa.array(v[at:at + len(texts)], t) for v, (_, t) in zip(columns, fields, strict=True)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], *own], [*keep, *[n for n, _ in fields]])

        held, chars = [], 0
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            held.append((batch, texts))
            chars += sum(len(t) for t in texts if t)
            if chars >= group_chars:
                yield from scored(held)
                held, chars = [], 0
        if held:
            yield from scored(held)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    return given.mapInArrow(run, f"{kept}, {schema}")
