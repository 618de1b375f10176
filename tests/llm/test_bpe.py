"""The trie encoder against the tokenizers library."""

import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm.bpe import WordBPE, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = WordBPE(json.load(open(PATH)))

TEXTS = [
    "", " \t\n", "Hello, World!  it's we'll THEY'RE", "naïve Ünïcödé ça été ΣΑΣ İstanbul ǅ", "aaaaaaaaaaaaaaaaaaaaaaaaaa",
    "<|startoftext|>a<|endoftext|> b <|STARTOFTEXT|>", "1234567890 3.14 $$$%%%&&& !!!??", "é a b　c d\x85e\x1cf",
    "中文 テスト 😀👍🏽 ​ x", "thththeheanananinin" * 50, "<|startoftext|", "ﬁ Å \x00 \x7f",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinothrs'lv.,!1éßñ \n"), max_size=60))
def test_random_words(text):
    assert OWN.encode(text) == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=30))
def test_random_text(text):
    assert OWN.encode(text) == LIB.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, None), (None, "b", "y"), (1, " \t\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_documents(docs, PATH).collect()
    assert len(got) == len(rows)
    for (i, t, _), r in zip(rows, got, strict=True):
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).collect() == []


def test_very_long_texts(spark):
    """A text of half a million words, and one unbroken chunk; neither stays in the caches."""
    long = "the quick brown fox's 12 jumps " * 80_000
    rows = [(1, long), (2, "qxv" * 9_000), (3, "x" * 70 + " y " + "x" * 70 + "!")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    for (i, t), r in zip(rows, got, strict=True):
        ids = LIB.encode(t, add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
