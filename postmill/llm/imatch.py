"""I-Match document fingerprints (DataFrame functions only).

Document frequencies of all terms are counted over the distinct texts of the corpus.  The lexicon holds the terms
within a band of inverse document frequency; a text keeps its distinct lexicon terms, sorts them, and hashes those of
several randomised subsets of the lexicon.  Subsets come at several rates, so short and long texts both have slots with few terms.
A text with fewer than ``MIN_TERMS`` lexicon terms is fingerprinted by subsets of all its terms instead.
Terms are counted by their 64-bit hash and stand in fingerprints by its upper half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import partitions, saved, span_of

#: The lexicon: terms in at least ``MIN_SHARE`` and at most ``MAX_SHARE`` of the distinct texts, and in ``MIN_DOCS``.
MIN_SHARE, MAX_SHARE, MIN_DOCS = 0.005, 0.02, 2
#: With fewer lexicon terms a text is fingerprinted by all its terms.
MIN_TERMS = 4
#: Slots: the whole lexicon, then for each of ``REPEATS`` hashes the subsets at rates 2^-r for r in ``RATES``.
RATES, REPEATS, BITS = range(1, 9), 3, 20
SLOTS = 1 + len(RATES) * REPEATS
#: A lexicon of at most so many terms is broadcast (8 bytes each); a larger one is joined by shuffle.
BROADCAST_TERMS = 1_000_000

BREAKS = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words of a text."""
    words = F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term): hashes of the terms whose document frequency lies in the band.  Copies of a text count once.

    In a small table the band holds the terms of ``MIN_DOCS`` texts at least.
    """
    body = span_of(F.col("text"))
    each = docs.select(F.xxhash64(body).alias("text_key"), terms(body).alias("terms")).groupBy("text_key").agg(
        F.first("terms").alias("terms"))
    total = docs.select(F.xxhash64(body)).distinct().count()
    counted = each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    least = max(MIN_DOCS, min_share * total)
    return saved(counted.filter(F.col("df").between(least, max(MIN_DOCS, max_share * total))).select("term"))


def slots_of(kept: Column, wide: Column) -> Column:
    """array<int> of SLOTS hashes from the distinct lexicon terms (array<int>) of a text; 0 where a subset is empty.

    Terms are sorted before they are hashed.  Texts with fewer than ``MIN_TERMS`` lexicon terms get ``wide``.
    """
    return F.when(F.size(kept) >= MIN_TERMS, _hashed(kept, REPEATS)).otherwise(wide)


def wide_slots(found: Column) -> Column:
    """array<int> of SLOTS hashes from all distinct terms of a text: the subsets of one repeat stand in for all."""
    return once(_hashed(F.transform(found, short), 1), lambda slots: F.concat(
        F.slice(slots, 1, 1), *[F.slice(slots, 2, len(RATES))] * REPEATS))


def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` bound to a variable: Spark would compute it again wherever a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashed(kept: Column, repeats: int) -> Column:
    """Hashes of the whole set and of its subsets at all rates for each repeat."""
    marked = F.transform(F.sort_array(F.array_distinct(kept)), lambda t: F.struct(
        t.alias("term"), F.xxhash64(t).alias("h")))

    def slot(terms_of: Column) -> Column:
        return F.when(F.size(terms_of) == 0, F.lit(0)).otherwise(short(F.xxhash64(terms_of)))

    def nested(every: Column, repeat: int) -> Column:  # each subset lies in the one at the rate before
        def step(acc: Column, below: Column) -> Column:
            part = F.filter(acc["left"], lambda t: F.shiftrightunsigned(t["h"], BITS * repeat).bitwiseAND(
                F.lit((1 << BITS) - 1)) < below)
            return once(part, lambda p: F.struct(p.alias("left"), F.array_append(acc["out"], slot(p)).alias("out")))

        none = F.array().cast("array<int>")
        return F.aggregate(F.array(*[F.lit(1 << BITS >> r) for r in RATES]),
                           F.struct(every.alias("left"), none.alias("out")), step, lambda acc: acc["out"])

    return once(marked, lambda every: F.concat(F.array(slot(every)), *[nested(every, q) for q in range(repeats)]))


def short(h: Column) -> Column:
    """The upper 32 bits of a 64-bit hash."""
    return F.shiftright(h, 32).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that are not empty in both; 1 for equal fingerprints."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1).otherwise(2))
    used = F.size(F.filter(pairs, lambda p: p > 0))
    return F.when(a == b, 1.0).when(used == 0, 0.0).otherwise(F.size(F.filter(pairs, lambda p: p == 1)) / used)


def digest(slots: Column) -> Column:
    return F.md5(F.concat_ws(",", F.transform(slots, lambda s: s.cast("string"))).cast("binary"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, next_id for every row: the next row by doc_id, after the last the first.

    Rows are dealt into ranges of doc_id whose bounds are ids that occur, and each range also gets the first row
    of the next one, so texts are shuffled once and every range is one small window.  Nulls come first; rows of one
    doc_id are ordered by the hash of their texts.  doc_id is an integer; rows without one form one range, since
    ranges are those of doc_id.
    """
    own = docs.select("doc_id", span_of(F.col("text")).alias("text"))
    count = 4 * partitions(docs.sparkSession)
    bounds = own.agg(
        F.percentile_approx("doc_id", [i / count for i in range(count)], 10 * count).alias("q"),
        F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    starts = sorted({*(bounds["q"] or []), *([bounds["least"]] if bounds["least"] is not None else [])})
    ids = F.array(*[F.lit(b) for b in starts]).cast("array<bigint>")
    found = F.aggregate(  # binary search: how many starts are at most doc_id
        F.sequence(F.lit(0), F.lit(max(1, len(starts)).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).when(
            F.get(ids, F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")) <= F.col("doc_id"),
            F.struct((F.floor((acc["lo"] + acc["hi"]) / 2).cast("int") + 1).alias("lo"), acc["hi"].alias("hi")))
        .otherwise(F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi"))),
        lambda acc: acc["lo"])
    last = max(1, len(starts))
    placed = own.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(found))
    is_first = F.get(ids, F.col("range") - 1) == F.col("doc_id")
    opens = (F.col("doc_id").isNull() if bounds["nulls"] else F.lit(False)) | F.coalesce(
        is_first & ((F.col("range") > 1) | F.lit(not bounds["nulls"])), F.lit(False))
    before = F.when(F.col("range") > 1, F.col("range") - 1).otherwise(F.lit(last))
    dealt = placed.select("doc_id", "text", F.explode(F.when(opens, F.array(
        F.struct("range", F.lit(0).alias("halo")), F.struct(before.alias("range"), F.lit(1).alias("halo"))))
        .otherwise(F.array(F.struct("range", F.lit(0).alias("halo"))))).alias("at")).select("doc_id", "text", "at.*")
    order = Window.partitionBy("range").orderBy("halo", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return dealt.select(
        "doc_id", "text", "halo", F.lead("text").over(order).alias("next_text"),
        F.lead("doc_id").over(order).alias("next_id")).filter("halo = 0").drop("halo")


def edited(text: Column, other: Column) -> Column:
    """The last half of ``text`` (rounded down, in code points) replaced by as many of the first of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null text counts as empty.  Equal texts have equal fingerprints, so repeated rows have; texts with fewer than
    ``MIN_TERMS`` lexicon terms are compared by subsets of all their terms.  doc_id is an integer or null.  The edit and
    the next document are those of :func:`with_next`; in a table of one row the next document is the row itself.  Other
    columns are not read; an empty table gives an empty result.
    """
    words = lexicon(docs, min_share, max_share)
    small = words.count() <= BROADCAST_TERMS
    following = F.coalesce("next_text", F.lit(""))
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), following)).withColumn(
        "own", terms(F.col("text"))).withColumn("new", terms(F.col("edited")))
    columns = {
        "n_chars": F.length("text").cast("long"), "text_key": F.xxhash64("text"), "next_key": F.xxhash64(following),
        "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256),
        "own_wide": wide_slots(F.col("own")), "new_wide": wide_slots(F.col("new")),
    }
    # each row goes on as its terms, and once as itself with a null term
    parts = rows.withColumns(columns | {"rid": F.monotonically_increasing_id()}).select(
        "rid", F.struct("doc_id", "next_id", *columns).alias("row"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("own").alias("terms")),
                          F.struct(F.lit(1).alias("which"), F.col("new").alias("terms")))).alias("s"))
    none = F.lit(None).cast("long")
    own_terms = F.when(F.col("s.which") == 0, F.concat(F.array(none), "s.terms")).otherwise(F.col("s.terms"))
    each = parts.select("rid", "row", "s.which", F.explode(own_terms).alias("term")).withColumn(
        "row", F.when(F.col("term").isNull(), F.col("row")))
    if small:
        known = words.withColumn("known", F.lit(True))
        kept = each.join(F.broadcast(known), "term", "left").filter("known or term is null").drop("known")
    else:  # rows themselves go around the join, where they would be one key
        kept = each.filter("term is not null").join(words, "term").unionByName(each.filter("term is null"))

    def of(which: int) -> Column:
        return F.collect_list(F.when(F.col("which") == which, short(F.col("term"))))

    grouped = kept.groupBy("rid").agg(F.first("row", ignorenulls=True).alias("row"), of(0).alias("own"), of(1).alias("new"))
    given = grouped.select("row.*", "own", "new")
    marked = saved(given.select(
        "doc_id", "next_id", *columns, (F.size("own") < MIN_TERMS).alias("own_few"), (F.size("new") < MIN_TERMS).alias("new_few"),
        slots_of(F.col("own"), F.col("own_wide")).alias("own_slots"), slots_of(F.col("new"), F.col("new_wide")).alias("new_slots")))
    others = marked.groupBy(F.col("doc_id").alias("next_id"), F.col("text_key").alias("next_key")).agg(
        F.first("own_slots").alias("next_slots"), F.first("own_wide").alias("next_wide"),
        F.first("own_few").alias("next_few"))

    def compared(other: str) -> Column:  # where one of the two has few lexicon terms, by all terms of both
        few = F.col("own_few") | F.col(f"{other}_few")
        return F.when(few, likeness(F.col("own_wide"), F.col(f"{other}_wide"))).otherwise(
            likeness(F.col("own_slots"), F.col(f"{other}_slots")))

    return marked.join(
        others, marked["next_id"].eqNullSafe(others["next_id"]) & (marked["next_key"] == others["next_key"]), "left",
    ).select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("own_slots")).alias("fingerprint"),
        digest(F.col("new_slots")).alias("edited_fingerprint"),
        compared("new").cast("double").alias("near_edited"),
        F.coalesce(compared("next"), F.lit(0.0)).cast("double").alias("near_next"))
