import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import katz
from postmill.llm.katz import K, discounts, frequent_contexts, score_documents


def plain_model(texts):
    """Unigram and conditional probabilities by the book, from dictionaries."""
    uni, bi = Counter(), Counter()
    for t in texts:
        words = ["$", *t.split(), "$"]
        uni.update(words[1:])
        bi.update(zip(words, words[1:]))
    total = sum(uni.values())
    of = lambda c: np.array([0, *[sum(v == r for v in c.values()) for r in range(1, K + 2)]])
    du, db = discounts(of(uni)), discounts(of(bi))
    cut = lambda d, r: d[r] * r if r <= K else r
    unknown = 1 - sum(cut(du, r) for r in uni.values()) / total if total else 1.0
    scale = 1.0
    if unknown < 1 / (total + 1):
        scale, unknown = (1 - 1 / (total + 1)) / (1 - unknown), 1 / (total + 1)
    p1 = lambda w: scale * cut(du, uni[w]) / total if uni[w] else unknown
    after = {}
    for (a, b), r in bi.items():
        after.setdefault(a, {})[b] = r

    def p2(a, b):
        if a not in after:
            return p1(b)
        seen = {w: cut(db, r) / uni[a] for w, r in after[a].items()}
        mass = sum(seen.values())
        left = max(1 - mass, 1 / (uni[a] + 1))
        if b in seen:
            return seen[b] * (1 - left) / mass
        return left / (1 - sum(p1(w) for w in seen)) * p1(b)

    return uni, p1, p2


@pytest.mark.parametrize("n,words,share", [(60, 12, 1 / 512), (120, 400, 0.003), (120, 400, 2.0), (3, 3, 0.1), (1, 1, 1 / 512)])
def test_against_plain_model(spark, monkeypatch, n, words, share):
    """With frequent contexts dealt over the buckets (all, some, the end alone) the model is the plain one."""
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    monkeypatch.setattr(katz, "HOT_SAMPLE", 1)
    rng = random.Random(n)
    vocabulary = [f"w{int(i ** 1.5)}" for i in range(words)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    rows = [(i, t, i % 5 != 1) for i, t in enumerate(texts)]
    rows += [(900, "unseen words only", False), (901, "", True), (902, None, False), (903, "W0\tw1\n W0", None), (None, "w0 w0", True),
             (0, texts[0], True)]
    low = lambda t: (t or "").lower()
    uni, p1, p2 = plain_model([low(t) for _, t, f in rows if f])
    total, kinds = sum(uni.values()), len(uni)
    want = []
    for i, t, _ in rows:
        w = ["$", *low(t).split(), "$"]
        want.append((str(i), len(w) - 1, sum(uni[x] > 0 for x in w[1:]), total,
                     sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w[1:]),
                     sum(math.log10(p2(a, b)) for a, b in zip(w, w[1:]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    docs = docs.withColumn("score", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    assert len(frequent_contexts(docs, share, 1)) >= 1 + (share < 0.1 and n > 1)
    got = score_documents(docs).collect()
    key = lambda r: (r[0], r[1], round(r[5], 6))
    got = sorted([(str(r[0]), *r[1:]) for r in got], key=key)
    want.sort(key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])
    for a in [*list(uni)[:15], "never"]:  # every conditional distribution sums to one, unknown words included
        assert sum(p2(a, b) for b in [*uni, "unknown"]) == pytest.approx(1)


def test_long_text_and_small_blocks(spark, monkeypatch):
    """A text that is longer than several blocks, and blocks of a few documents, give what one block gives."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.random() ** 3 * 500)}" for _ in range(n)), True) for i, n in enumerate([20_000, *[30] * 50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(2)
    want = {r.doc_id: (r.n_tokens, r.base_score, r.score) for r in score_documents(docs).collect()}
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 100)
    got = {r.doc_id: (r.n_tokens, r.base_score, r.score) for r in score_documents(docs).collect()}
    assert set(got) == set(want) and want[0][0] == 20_001
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_held_out_texts_are_likelier_than_by_words(spark):
    """On texts that were not learned from, the bigrams tell more than the words alone."""
    rng = random.Random(4)
    after = {w: rng.sample(range(60), 4) for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(40):
            out.append(f"w{w}")
            w = rng.choice(after[w])
        return " ".join(out)

    rows = [(i, text(), i % 5 != 1) for i in range(300)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).filter("doc_id % 5 = 1").collect()
    assert sum(r.score > r.base_score for r in got) >= 0.95 * len(got)


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string, train boolean")).collect() == []
    one = score_documents(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.score) == (3, 0, 0, 0.0)
