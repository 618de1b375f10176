"""The pipeline's stages, each on what the stage before it kept, against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from test_secrets import listed, plain_added, plain_spans
from test_similar import plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from postmill.llm.common import documents, fold
from postmill.llm.language import MIN_MARGIN, Identifier, fit_dictionaries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = documents(spark, SF), []
    rows = docs.limit(3).withColumn("text", fold() * 0).selectExpr("doc_id + 5000 doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    docs = docs.unionByName(rows).unionByName(docs.limit(4))
    docs.write.parquet(str(folder / "in"))
    docs = spark.read.parquet(str(folder / "in"))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        result.write.parquet(str(folder / name))
        found = spark.read.parquet(str(folder / name))
        out.append((docs.collect(), found.collect(), docs))
        docs = found
    return out


def test_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    for _, _, docs in stages:
        assert docs.columns == corpus_pipeline.COLUMNS


def test_language(stages):
    given, kept, docs = stages[0]
    model = Identifier(fit_dictionaries(docs.filter(fold() != 0)))
    stay = [r for r in given if (p := model.predict(r.text))[0] != "und" and p[1] >= MIN_MARGIN]
    assert sorted(map(tuple, kept)) == sorted(map(tuple, stay)) and len(kept) > 0.9 * len(given)


def test_exact(stages):
    given, kept, _ = stages[1]
    best = {}
    for r in given:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((i, t) for t, i in best.items())


def test_near(stages):
    given, kept, _ = stages[2]
    groups = plain_groups([r.text for r in given])
    least = {}
    for r, g in zip(given, groups, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_secrets(stages):
    given, kept, _ = stages[3]
    rows = [(r.doc_id, r.text, r.source) for r in given]
    want = {}
    for (i, text, _), more in zip(rows, plain_added(rows), strict=True):
        cover = [False] * len(text)
        for a, _, b in plain_spans(text) + more:
            cover[a:b] = [True] * (b - a)
        want[i] = re.sub("\0+", "[SECRET]", "".join("\0" if c else ch for ch, c in zip(text, cover, strict=True)))
    assert {r.doc_id: r.text for r in kept} == want and all(r.n_chars == len(r.text) for r in kept)
    assert not any(plain_spans(r.text) for r in kept)


def test_packing(stages):
    given, kept, _ = stages[4]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in given}
    sums, used = {}, {}
    for r in kept:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sums == total
    for pieces in used.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(used) <= 1.1 * sum(total.values()) / 2048 + 1


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_digest_helper():
    assert listed([]) == "" and hashlib.sha256(b"").hexdigest().startswith("e3b0")
