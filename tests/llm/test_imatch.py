import hashlib
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm import imatch
from postmill.llm.imatch import BITS, MIN_TERMS, RATES, REPEATS, fingerprint_documents, lexicon, likeness, with_next


def data(n, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), n)
    return [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))) + "é😀"[: i % 3])
            for i in ids]


@pytest.mark.parametrize("rows", [
    data(60), data(1), data(2), [*data(20), (None, "null id"), (None, "other"), (3, None)], [(5, "x"), (5, "y"), (6, "z")],
])
def test_next_and_edit(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, range string")
    got = with_next(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [r[0] for r in order]
    if len(set(ids)) == len(ids):
        nexts = {order[k - 1][0]: (order[k][0], order[k][1] or "") for k in range(len(order))}
        assert {r.doc_id: (r.next_id, r.next_text) for r in got} == nexts
        out = fingerprint_documents(docs).collect()
        for r in out:
            t = dict(rows)[r.doc_id] or ""
            half = len(t) // 2
            e = t[: len(t) - half] + nexts[r.doc_id][1][:half]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i in ids)


def test_fingerprints(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(300)]
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1002, "solo"), (1003, "SOLO"), (1004, ""), (1005, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint_documents(docs, 0.01, 0.2).collect()}
    assert len(out) == len(rows)
    assert out[7].fingerprint == out[1000].fingerprint == out[1001].fingerprint
    assert out[1000].near_next == 1.0 and out[1002].near_next == 1.0 and out[1004].near_next == 1.0
    assert out[1002].fingerprint == out[1003].fingerprint != out[1004].fingerprint
    plain = [out[i] for i in range(300)]
    assert sum(r.near_edited for r in plain) > 4 * sum(r.near_next for r in plain)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())
    again = {r.doc_id: r for r in fingerprint_documents(docs.repartition(7), 0.01, 0.2).collect()}
    assert again == out
    assert fingerprint_documents(docs.limit(0)).count() == 0


def test_likeness(spark):
    row = spark.range(1).selectExpr("array(1,2,0,0) a", "array(1,3,0,4) b", "array(0,0,0,0) z")
    a, b, z = (row[c] for c in "abz")
    assert row.select(likeness(a, b), likeness(a, a), likeness(z, z), likeness(a, z)).first()[:] == (1 / 3, 1.0, 1.0, 0.0)


def test_copies_and_few_terms(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6000)]
    plain = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(400)]
    rare = [" ".join(f"r{k}x{i}" for i in range(60)) for k in range(20)]  # no term of another text
    texts = plain + plain[:10] * 40 + rare
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    for group in (plain[:10], rare):
        rows = [out[i] for i, t in enumerate(texts) if t in group and t != texts[(i + 1) % len(texts)]]
        assert sum(r.near_edited for r in rows) > max(0.03 * len(rows), 4 * sum(r.near_next for r in rows))
        assert len({r.fingerprint for r in rows}) == len(group)
    small = spark.createDataFrame([(k, f"a b c d e own{k}" if k < 2 else f"only{k}") for k in range(20)], "doc_id long, text string")
    assert lexicon(small).count() == 5


def _signed(x, bits=64):
    return x - (1 << bits) if x >> (bits - 1) else x


def plain_slots(kept, repeats):
    """Hashes of the whole set and of its subsets, chained over the sorted terms as the hash of an array is."""
    def h(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    own = {t: h(struct.pack("<i", t)) for t in kept}
    subsets = [sorted(kept)] + [[t for t in sorted(kept) if (own[t] >> BITS * q & (1 << BITS) - 1) < 1 << BITS >> r]
                                for q in range(repeats) for r in RATES]
    out = []
    for s in subsets:
        seed = 42
        for t in s:
            seed = h(struct.pack("<q", _signed(own[t])), h(struct.pack("<i", t), seed))
        out.append(_signed(seed >> 32, 32) if s else 0)
    return out


def plain_fingerprints(rows, low, high):
    """Fingerprints and likenesses of (doc_id, text) rows by the book: counts, bands, subsets, shares of equal slots."""
    ordered = sorted(rows)
    texts = [t or "" for _, t in ordered]
    term = lambda w: _signed(xxhash.xxh64_intdigest(w.encode(), 42))
    terms = lambda t: {term(w) for w in t.lower().split()}
    df = Counter(x for t in set(texts) for x in terms(t))
    n = len(set(texts))
    band = {x for x, c in df.items() if max(2, low * n) <= c <= max(2, high * n)}

    def slots(text):
        all_terms = terms(text)
        kept = {x >> 32 for x in all_terms & band}
        wide = plain_slots({x >> 32 for x in all_terms}, 1)
        wide = wide[:1] + wide[1:] * REPEATS
        few = len(all_terms & band) < MIN_TERMS
        return few, wide, wide if few else plain_slots(kept, REPEATS)

    def alike(a, b):
        x, y = (a[1], b[1]) if a[0] or b[0] else (a[2], b[2])
        used = [(p, q) for p, q in zip(x, y) if p or q]
        return 1.0 if x == y else sum(p == q for p, q in used) / len(used) if used else 0.0

    out = {}
    for k, (i, _) in enumerate(ordered):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        own, new, after = (slots(t) for t in (text, text[:len(text) - half] + following[:half], following))
        mark = lambda s: hashlib.md5(",".join(map(str, s)).encode()).hexdigest()
        out[i] = (mark(own[2]), mark(new[2]), alike(own, new), alike(own, after))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_fingerprints_by_the_book(spark, monkeypatch, most):
    """Against plain Python, with the lexicon broadcast and with a shuffled one."""
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", most)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(500, rows[3][1]), (501, rows[4][1]), (502, None), (503, "one w1"), (504, "Own words only"), (505, "w1 w2 w3 é " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint_documents(docs, 0.02, 0.15).collect()}
    want = plain_fingerprints(rows, 0.02, 0.15)
    assert set(got) == set(want)
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][2:] == pytest.approx(want[i][2:]), i


def test_terms_are_sorted_once_for_all_slots(spark):
    rows = spark.createDataFrame([([1, 2],)], "t array<long>")
    for slots in (imatch.wide_slots(F.col("t")), imatch.slots_of(F.col("t").cast("array<int>"), F.lit(None).cast("array<int>"))):
        plan = rows.select(slots.alias("s"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("array_distinct(") == 1 and plan.count("shiftrightunsigned(") <= REPEATS
