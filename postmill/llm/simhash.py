"""SimHash near-duplicates with deletion-variant signatures.

A text's fingerprint takes, bit by bit, the majority over the 64-bit hashes of its word shingles.  Two fingerprints
link at ``DISTANCE`` = 2 or fewer differing bits.  Cut into two halves, such a pair differs in one half by at most
one bit: either its first half does, or its second halves are equal.  So every distinct fingerprint is indexed under
its exact halves and under each one-wildcard variant of its first half; an equality join on these keys finds all
candidates, and the join condition verifies the distance.  A variant joins fingerprints whose wildcard bit is 0 to
those where it is 1, which leaves equal halves to the exact key.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import map_texts, saved
from postmill.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 2
HALF = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash.  ASCII letters are lowered, words end at ASCII white space; no words: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        part = words[start:start + (1 << 16) + shingle - 1]
        h = np.array([digest(join(s), SEED) for s in zip(*[part[k:] for k in range(shingle)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` (default doc_id) and fp of every row; null text counts as empty, whose fingerprint is zero.

    Repeated rows give repeated results; columns that are not kept are not read; an empty table gives an empty result.
    """
    return map_texts(docs, keep or ["doc_id"], "fp long",
                     lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): all pairs of the distinct values of fp that differ in 1 or 2 bits, each once; a null fp links to none."""
    fp = F.col("fp")
    first = F.shiftrightunsigned(fp, HALF)
    second = fp.bitwiseAND(F.lit((1 << HALF) - 1))
    exact = [first, second.bitwiseOR(F.lit(40 << HALF))]

    def side(bit: int) -> DataFrame:
        variants = F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda j: F.when(
            F.getbit(first, j) == bit,
            first.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
            .bitwiseOR(F.call_function("shiftleft", (j + 1).cast("long"), F.lit(HALF)))))
        return distinct.select(fp, F.explode(F.concat(F.array(*exact), F.array_compact(variants))).alias("key"))

    low, high = side(0).withColumnRenamed("fp", "u"), side(1).withColumnRenamed("fp", "v")
    differ = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    own = (F.col("key") >= F.lit(1 << HALF)) & (F.col("key") < F.lit(40 << HALF))  # a wildcard key orders the pair
    return low.join(high, "key").filter(differ.between(1, DISTANCE) & (own | (F.col("u") < F.col("v")))).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links, the row's own included.  Null text counts
    as empty: fingerprint zero, linked like any other.  A null doc_id is never a component_id unless all rows of
    the component have none.  Repeated rows give repeated results; other columns are not read; an empty table gives an
    empty result.
    """
    marked = saved(fingerprints(docs, shingle=shingle))
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = distinct.join(connected_components(links(distinct)), distinct["fp"] == F.col("node"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = saved(
        distinct.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left")
        .select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")
