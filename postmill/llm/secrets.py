"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Base kinds are found by patterns.  Besides them every long token of mixed characters is a candidate.  Over the
whole corpus, candidate hashes are aggregated by distinct repositories and owners.  A repository is a distinct text,
so copies of a text add nothing; its owner is the smallest value of the owner column among its copies.  What many
owners hold, or what one owner holds in many texts, is a widely copied example; the rest looks like a live credential
of its owner and is added to the spans.
Texts are read once and never shuffled; matches, hashes and counts travel.  Places come from running sums over the
matches of a text, so the work grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import saved, span_of

#: The base kinds in their order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "owner")
LEAST_VALUE = 8

#: Candidates: tokens of at least 20 characters with a letter, a digit and so many distinct characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
MIN_DISTINCT = 8
#: A live credential has so many owners at most, and lies in so many repositories an owner at most.
MAX_OWNERS, MAX_REPOSITORIES = 2, 5

#: What every text with a match that counts holds besides; these are quick to rule out.
_ASSIGN_HINT = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""
_OWNER = KINDS.index("owner")
#: Characters of the blocks that a text is cut into before parts of it are taken.
BLOCK = 1024


def _looks_random(token: Column) -> Column:
    return (
        F.regexp_like(token, F.lit("[A-Za-z]")) & F.regexp_like(token, F.lit("[0-9]"))
        & (F.size(F.array_distinct(F.split(token, ""))) >= MIN_DISTINCT)
    )


def _holds(text: Column, kind: str) -> Column:
    """Whether a text has a match of the kind's pattern that may count."""
    if kind == "assign":
        return F.regexp_like(text, F.lit(_ASSIGN_HINT)) & F.regexp_like(text, F.lit(ASSIGN))
    if kind == "access":
        return F.contains(text, F.lit("AKIA")) & F.regexp_like(text, F.lit(ACCESS))
    if kind == "hex":
        return F.regexp_like(text, F.lit(HEX))
    return F.regexp_like(text, F.lit("[0-9]")) & F.regexp_like(text, F.lit(CANDIDATE))


def _matches(text: Column, kind: str) -> Column:
    """struct<rank, found: array<struct<gap, size, counts, hash>>> of the leftmost non-overlapping matches.

    ``gap`` is the number of code points since the match before; ``counts`` is false for a match that is dropped.
    """
    pattern, group = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "owner": (CANDIDATE, 0)}[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(whole))
    sizes = F.zip_with(gaps, whole, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size")))
    counts = {"assign": lambda v: F.length(v) >= LEAST_VALUE, "owner": _looks_random}.get(kind, lambda v: F.lit(True))
    own = F.xxhash64 if kind == "owner" else lambda v: F.lit(None).cast("long")
    found = F.zip_with(sizes, values, lambda s, v: F.struct(
        s["gap"].alias("gap"), s["size"].alias("size"), counts(v).alias("counts"), own(v).alias("hash")))
    none = F.array().cast("array<struct<gap:int,size:int,counts:boolean,hash:bigint>>")
    return F.struct(F.lit(KINDS.index(kind)).alias("rank"),
                    F.when(_holds(text, kind), found).otherwise(none).alias("found"))


def _placed(docs: DataFrame, owner: str, row: Column) -> tuple[DataFrame, DataFrame]:
    """(rid, row, text_sha256) of every document, and (rid, rank, start, end) of every span, kept ones and candidates.

    Candidates (rank of ``owner``) have ``live`` and ``in_base`` besides, which are null for the base kinds.
    """
    text = span_of(F.col("text"))
    found = saved(docs.select(
        F.monotonically_increasing_id().alias("rid"), row.alias("row"), F.col(owner).alias("owner"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.xxhash64(text).alias("repository"),
        F.filter(F.array(*[_matches(text, k) for k in KINDS]), lambda k: F.size(k["found"]) > 0).alias("kinds")))
    each = found.select("rid", "owner", "repository", F.explode("kinds").alias("k")).select(
        "rid", "owner", "repository", "k.rank", F.posexplode("k.found").alias("place", "m"))
    upto = Window.partitionBy("rid", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.repartition("rid").withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto))
    spans = ends.filter("m.counts").select(
        "rid", "owner", "repository", "rank", (F.col("end") - F.col("m.size")).cast("int").alias("start"),
        F.col("end").cast("int").alias("end"), "m.hash")
    # a candidate meets a base span that starts no later and reaches over its start, or one that starts within it
    before = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("rank") < _OWNER
    meets = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | F.coalesce(
        F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    spans = saved(spans.withColumn("in_base", F.when(~base, meets)))
    candidates = spans.filter(~base)
    held = (
        candidates.groupBy("hash", "repository").agg(F.min("owner").alias("owner"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    live = (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES * F.col("owners"))
    judged = candidates.join(held.select("hash", live.alias("live")), "hash")
    columns = ["rid", "rank", "start", "end", "in_base"]
    placed = spans.filter(base).select(*columns, F.lit(None).cast("boolean").alias("live")).unionByName(
        judged.select(*columns, "live"))
    return found.select("rid", "row", "text_sha256"), placed


def _stays() -> Column:
    """Whether a span is given out: base ones, and live candidates outside of them."""
    return F.col("live").isNull() | (F.col("live") & ~F.col("in_base"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, all_spans, n_examples, text_sha256 for every row of ``docs``.

    Spans are array<struct<start, rank, end>> with rank the kind's place in ``KINDS``; places count code points, ends
    are exclusive.  ``n_examples`` counts the row's candidates that are widely copied.  A null owner is an owner of its
    own.  Null text counts as empty; repeated rows give repeated results; other columns are not read; an empty table
    gives an empty result.
    """
    found, placed = _placed(docs, owner, F.struct("doc_id"))
    span = F.struct("start", "rank", "end")

    def n(kind: str) -> Column:
        return F.count_if(F.col("rank") == KINDS.index(kind))

    spans = placed.groupBy("rid").agg(
        n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.collect_list(F.when(F.col("rank") < _OWNER, span)).alias("base_spans"),
        F.collect_list(F.when(_stays(), span)).alias("all_spans"), F.count_if(~F.col("live")).alias("n_examples"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    rows = found.join(spans, "rid", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return rows.select(
        "row.doc_id", *counts, *[F.coalesce(c, none).alias(c) for c in ("base_spans", "all_spans")],
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"), "text_sha256")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_examples."""
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("all_spans")).alias("spans"), "n_examples")


def cut_out(text: Column, cuts: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every cut replaced by ``mark``; cuts (array<struct<start, end>>) are sorted and do not touch.

    The text is first cut into blocks of ``BLOCK`` characters, so taking the parts between cuts costs no more than a
    block and the part itself; everything that is used repeatedly is an argument of a lambda, evaluated once.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    given = F.struct(
        blocks.alias("blocks"),
        F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"])).alias("from"),
        F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length(text))).alias("to"))

    def part(x: Column):
        def taken(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK), F.floor((b - 1) / BLOCK)
            held = F.array_join(F.slice(x["blocks"], (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return F.when(b <= a, "").otherwise(F.substring(held, (a - first * BLOCK + 1).cast("int"), (b - a).cast("int")))
        return taken

    joined = F.transform(F.array(given), lambda x: F.array_join(F.zip_with(x["from"], x["to"], part(x)), mark))
    return F.when(F.size(cuts) > 0, F.element_at(joined, 1)).otherwise(text)


def redact_documents(docs: DataFrame, owner: str = "source") -> DataFrame:
    """``docs`` with all spans of :func:`scan` replaced in text; every row and column stays, null text stays null.

    Overlapping or touching spans become one mark.  Only rows in which some pattern matches are written, scanned and
    joined; the others pass through.
    """
    text = span_of(F.col("text"))
    hit = F.lit(False)
    for kind in KINDS:
        hit = hit | _holds(text, kind)
    found, placed = _placed(docs.filter(hit), owner, F.struct(*docs.columns))
    order = Window.partitionBy("rid").orderBy("start", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach >= F.col("start"), 0).otherwise(1)
    cuts = (
        placed.filter(_stays()).select("rid", "start", "rank", "end").withColumn("opens", opens)
        .withColumn("cut", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    cleaned = found.join(cuts, "rid", "left").select("row.*", F.coalesce("_cuts", none).alias("_cuts")).withColumn(
        "text", cut_out(F.col("text"), F.col("_cuts")))
    return docs.filter(~hit).unionByName(cleaned.select(*docs.columns))
