"""Near-duplicates by SimHash at a given similarity of word shingles: operator 2 with links that are verified.

A text is the set of the 64-bit hashes of its ``SHINGLE``-word shingles, and two texts link if the Jaccard similarity
of their sets is at least ``SIMILARITY``.  Candidates come from two searches:

* SimHash fingerprints of the sets, linked at 2 or fewer differing bits by deletion-variant signatures
  (:func:`postmill.llm.simhash.links`), which joins the closest copies;
* bands of MinHash values.  Texts at a similarity of 0.8 differ in some ten of 64 SimHash bits, which would take
  segments of ten bits with a wildcard each: keys of nine bits, in which everything collides.  Bands of ``BAND``
  values of 64 bits find a pair at 0.8 with probability 1 - (1 - 0.8^5)^20 = 0.9996 and hardly collide otherwise.

Every candidate is verified by the sets.  A bucket's members are first compared with one of them, which joins most of
a large group at a cost that grows with its members.  Only members of different components are compared after that: as
pairs where a bucket is small, and in blocks of a large bucket within the condition of a join, which emits links only.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm import simhash
from postmill.llm.common import map_texts, partitions, saved, span_of
from postmill.llm.components import connected_components

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
BANDS, BAND = 20, 5
#: Of one bit of each of the 100 signature values, a pair at ``SIMILARITY`` differs in 10 (standard deviation 3), and
#: in more than so many once in ten thousand times.
MAX_BITS = 22
#: Buckets of more members are compared in blocks of so many.
SMALL_BUCKET, BLOCK = 48, 512

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
PART = 4096


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes.  Words are those of SimHash; a text of fewer words is one shingle, of none is empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(join(s), SEED) for s in zip(*[words[k:] for k in range(shingle)])], np.uint64))


def sketch(text: str | None) -> tuple[int, int, list[int], list[int], int]:
    """(identifier of the set, its size, a hash for each band, two longs of signature bits, SimHash of the set)."""
    own = shingles(text)
    if not len(own):
        return 0, 0, [], [0, 0], 0
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(own), PART):
        part = own[start:start + PART]
        np.minimum(least, (part[:, None] * _FACTORS).min(axis=0), out=least)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bands = [_signed(xxhash.xxh64_intdigest(least[b * BAND:(b + 1) * BAND].tobytes(), b)) for b in range(BANDS)]
    bits = np.zeros(128, np.uint8)
    bits[:BANDS * BAND] = (least * _MIX) >> np.uint64(63)
    fp = int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])
    return (_signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)), len(own), bands, np.packbits(bits).view("<i8").tolist(), fp)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def row_key() -> Column:
    """One column for a doc_id and its text: rows that are equal in both have equal keys."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                       F.sha2(span_of(F.col("text")).cast("binary"), 256))


def _shingle_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, shingles) for the rows (node, _key), which name one text of each set.

    Candidates are verified by the upper halves of the hashes, which are half as much to move; in a pair of texts of a
    thousand shingles two different ones coincide once in some four thousand pairs.
    """
    texts = docs.select(row_key().alias("_key"), "text").join(rows, "_key").select("node", "text")
    found = map_texts(texts, ["node"], "shingles array<int>", lambda: lambda batch: [
        [np.unique(shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch]])
    return saved(found.dropDuplicates(["node"]))


def _may_link(a: str, b: str, similarity: float) -> Column:
    """What a pair of at least that similarity fulfils: by size always, by signature bits but for one in ten thousand."""
    n = F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * F.lit(similarity)
    far = [F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(2)]
    return n & (far[0] + far[1] <= MAX_BITS)


def _alike(a: Column, b: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= (F.size(a) + F.size(b) - shared) * F.lit(similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v"))
    return both.filter(_alike(F.col("a"), F.col("b"), similarity)).select("u", "v")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (u, v): sets of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    first = saved(nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    ends = simhash.links(first).withColumnsRenamed({"u": "fu", "v": "fv"})
    linked = (
        ends.join(first.select(F.col("fp").alias("fu"), F.col("first").alias("u")), "fu")
        .join(first.select(F.col("fp").alias("fv"), F.col("first").alias("v")), "fv"))
    return same.unionByName(linked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def _rest(now: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between the members (bucket, x, root) of a bucket that lie in different components."""
    several = now.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
    rest = saved(now.join(several.select("bucket", "c"), "bucket"))
    small = rest.filter(F.col("c") <= SMALL_BUCKET)
    pairs = _pairs(
        small.select("bucket", F.col("x").alias("a"), "root").join(
            small.select("bucket", F.col("x").alias("b"), F.col("root").alias("other")), "bucket")
        .filter((F.col("root") < F.col("other")) & _may_link("a", "b", similarity)))
    # a large bucket is cut into blocks of members; each pair of blocks is a key of its own
    large = rest.filter(F.col("c") > SMALL_BUCKET).join(sets, F.col("x.node") == F.col("node")).drop("node")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("x.node"), blocks).cast("int")
    dealt = large.withColumn("own", own).withColumn(
        "at", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
            F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))))
    key = ["bucket", F.col("at.i").alias("i"), F.col("at.j").alias("j")]
    a = dealt.select(*key, F.col("x").alias("a"), "root", F.col("shingles").alias("sa"), F.col("own").alias("oa"))
    b = dealt.select(*key, F.col("x").alias("b"), F.col("root").alias("other"), F.col("shingles").alias("sb"),
                     F.col("own").alias("ob"))
    blocked = a.join(b, (a["bucket"] == b["bucket"]) & (a["i"] == b["i"]) & (a["j"] == b["j"])
                     & (F.col("root") < F.col("other")) & ((F.col("oa") != F.col("ob")) | (a["i"] == a["j"]))
                     & _may_link("a", "b", similarity) & _alike(F.col("sa"), F.col("sb"), similarity))
    # a skewed join may be split into very many pieces, whose results are few links
    few = blocked.select("a", "b").coalesce(4 * partitions(now.sparkSession))
    return _verified(pairs, sets, similarity).unionByName(_pairs(few))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, _key and group_id of every row of ``docs``: equal for rows that links at ``similarity`` connect.

    Null text counts as empty; texts without words are one group.  Repeated rows give repeated results; an empty
    table gives an empty one; other columns than doc_id and text are not read.
    """
    marked = saved(map_texts(
        docs.select("doc_id", row_key().alias("_key"), "text"), ["doc_id", "_key"],
        "node long, n long, bands array<long>, bits array<long>, fp long",
        lambda: lambda texts: list(zip(*map(sketch, texts))) or [[]] * 5))
    nodes = saved(marked.groupBy("node").agg(
        F.min("_key").alias("_key"), *[F.first(c).alias(c) for c in ("n", "bands", "bits", "fp")]))
    close = saved(_by_simhash(nodes))
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    members = saved(dealt.join(shared, "bucket").join(nodes.select("node", "n", "bits"), "node").select(
        "bucket", F.struct("node", "n", "bits").alias("x")))
    wanted = members.select("x.node").unionByName(close.select(F.col("u").alias("node"))).unionByName(
        close.select(F.col("v").alias("node"))).distinct()
    sets = _shingle_sets(docs, nodes.select("node", "_key").join(wanted, "node"))
    # the first links: of the fingerprints, and of each bucket's members with one of them
    pivots = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "x.node"), "x")).alias("p")).select(
        "bucket", F.col("p.x").alias("b"))
    spokes = _pairs(members.withColumnRenamed("x", "a").join(saved(pivots), "bucket").filter(
        (F.col("a.node") != F.col("b.node")) & _may_link("a", "b", similarity)))
    components = connected_components(_verified(close.unionByName(spokes).distinct(), sets, similarity))
    own = F.col("x.node")
    now = members.join(components, own == F.col("node"), "left").select("bucket", "x", F.coalesce("root", own).alias("root"))
    more = _rest(now, sets, similarity)
    # the other links connect components: a small graph whose vertices are their roots
    for end in ("u", "v"):
        roots = components.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        more = more.join(roots, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    joined = connected_components(more).select(F.col("node").alias("group_id"), F.col("root").alias("joined"))
    grouped = marked.join(components, "node", "left").select("doc_id", "_key", F.coalesce("root", "node").alias("group_id"))
    return grouped.join(joined, "group_id", "left").select("doc_id", "_key", F.coalesce("joined", "group_id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Exactly one row of each group of :func:`near_groups`, with all columns.

    It is the one with the smallest doc_id, a null one being larger than any other, then with the smallest hash of
    its text; of rows that are equal in both, any.
    """
    kept = near_groups(docs, similarity).groupBy("group_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("best")).select("best._key")
    stay = docs.withColumn("_key", row_key()).join(kept, "_key", "left_semi")
    first = Window.partitionBy("_key").orderBy(F.lit(1))  # as the join is partitioned: no exchange
    return stay.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*docs.columns)
