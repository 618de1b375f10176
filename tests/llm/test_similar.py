import random

import pytest
from test_simhash import plain_components

import corpus_pipeline
from postmill.llm import similar


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts, similarity=0.8):
    sets = [plain_shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i)
             if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return plain_components(len(texts), alike)


def edited(rng, words, changes):
    words = list(words)
    for k in rng.sample(range(len(words)), changes):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = ["", None, "Few words", "few  WORDS", "other words"]
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        out += [" ".join(base), *[edited(rng, base, k) for k in (1, 1, 3, 6, 12)]]
    hot = [f"w{rng.randrange(5000)}" for _ in range(200)]
    out += [edited(rng, hot, rng.randrange(1, 12)) for _ in range(150)]  # one large group, some of its pairs too far
    chain = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for _ in range(12):  # neighbours are near, the ends are not
        chain = edited(rng, chain, 2).split()
        out.append(" ".join(chain))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small,block", [(48, 512), (2, 8), (1000, 512)])
def test_groups(spark, texts, monkeypatch, small, block):
    """Small buckets as pairs, and all in small blocks of large ones, give the groups of a comparison of all pairs."""
    monkeypatch.setattr(similar, "SMALL_BUCKET", small)
    monkeypatch.setattr(similar, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want, got = plain_groups(texts), {r.doc_id: r.group_id for r in similar.near_groups(docs).collect()}
    assert len(set(want)) < len(texts) - 150
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    assert similar.drop_near_duplicates(docs.limit(0)).count() == 0


def test_stage(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    least = {}
    for i, g in enumerate(plain_groups(texts)):
        least.setdefault(g, i)
    kept = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    assert all(r.text == texts[r.doc_id] for r in kept)
