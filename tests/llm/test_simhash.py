import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm.components import connected_components
from postmill.llm.simhash import fingerprint, near_duplicates


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉ \t\n x"), max_size=40))
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def plain_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(150, 199)]
    want = plain_components(200, edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, monkeypatch):
    """All pairs of planted fingerprints against brute force, then whole documents."""
    import postmill.llm.simhash as simhash

    rng = np.random.default_rng(5)
    fps = [0, -1, 1 << 31, 3 << 32]
    for _ in range(40):
        base = int(rng.integers(-(1 << 63), (1 << 63) - 1))
        fps += [base, *[simhash._signed((base % (1 << 64)) ^ sum({1 << int(b) for b in rng.integers(0, 64, k)}))
                        for k in (1, 2, 2, 2, 3, 4)]]
    fps = sorted(set(fps))
    want = {(i, j) for i in range(len(fps)) for j in range(i)
            if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 2}
    got = {(max(fps.index(r.u), fps.index(r.v)), min(fps.index(r.u), fps.index(r.v)))
           for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == want

    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(25):
        t = rng.choice(words, 40).tolist()
        texts += [" ".join(t), " ".join(t[:-1] + ["zz"]), " ".join(["A"] + t[1:]), " ".join(t)]
    texts += [None, "", "one", "ONE", "one two"]
    rows = [(i * 3 % 107, t, None) for i, t in enumerate(texts)] + [(None, "one", "x"), (0, texts[0], "x")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(out) == len(rows)
    plain = [plain_fingerprint(t) for _, t, _ in rows]
    group = plain_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                                         if (plain[i] ^ plain[j]).bit_count() <= 2])
    least = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        least[g] = min(x for x in (least.get(g), i) if x is not None)
    have = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in out)
    assert have == sorted((str(i), plain[k], least[group[k]]) for k, (i, _, _) in enumerate(rows))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
