import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postmill.llm.exact_dedup import CHUNKS, drop_exact_duplicates, exact_duplicates


def rows():
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "é😀"]) for _ in range(rng.randrange(1, 30))) + rng.choice([". ", "\n", "! "])
    texts = ["".join(sentence() for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += ["x" * 9000, "x" * 9001, "", None, "A", "a", "a "]
    data = [(i * 7 % 501, t, "k") for i, t in enumerate(texts)]
    data += [(600 + i, rng.choice(texts), None) for i in range(60)] + [(None, texts[0], None), data[3], data[3], (None, "only null ids", None), (None, "only null ids", None)]
    return data


@pytest.mark.parametrize("bits", [64, 5])
def test_groups(spark, bits):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, kept string")
    got = exact_duplicates(docs, id_bits=bits).collect()
    assert len(got) == len(data)
    groups = {}
    for i, t, _ in data:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in data:
        ids = [x for x in groups[t or ""] if x is not None]
        want.append((str(i), str(max(ids) if ids else None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in got if r.kept]
    assert len(kept) == len({k[0] for k in kept}) == len(groups) and all(i == k for _, i, k in kept)
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_drop(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, kept string")
    got = drop_exact_duplicates(docs).collect()
    assert sorted((r.text or "") for r in got) == sorted({t or "" for _, t, _ in data}) and got[0].__fields__ == docs.columns


def test_chunks_cover_the_text(spark):
    texts = [t for _, t, _ in rows() if t]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", F.regexp_extract_all("text", F.lit(CHUNKS), F.lit(0)).alias("c")).collect():
        assert "".join(r.c) == r.text and len(r.c) <= len(r.text) // 256 + 1
