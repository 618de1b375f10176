import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm.packing import best_fit_decreasing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(sizes, window):
    """One piece at a time, a list of windows."""
    left = []
    for length in sorted((n for n, c in sizes.items() for _ in range(c)), reverse=True):
        fits = [i for i, r in enumerate(left) if r >= length]
        if fits:
            i = min(fits, key=lambda i: left[i])
            left[i] -= length
        else:
            left.append(window - length)
    return sorted(left)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 12), max_size=12))
def test_plan_is_best_fit_decreasing(sizes):
    used, placed = {}, {}
    for length, lo, hi, each, first, offset in best_fit_decreasing(sizes, 20):
        for i in range(lo, hi + 1):
            at = (first + (i - lo) // each, offset + (i - lo) % each * length)
            used.setdefault(at[0], []).append((at[1], length))
            placed[length] = placed.get(length, 0) + 1
    assert placed == sizes
    for pieces in used.values():
        pieces.sort()
        end = 0
        for start, length in pieces:
            assert start == end
            end += length
        assert end <= 20
    assert sorted(20 - sum(n for _, n in p) for p in used.values()) == plain_best_fit(sizes, 20)


def test_documents(spark):
    rng = random.Random(1)
    words = ["alpha", "beta's", "x1", "Ünï", "<|endoftext|>"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(300)] + ["", None, "solo " * 500]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = pack_documents(docs, PATH, window=64).collect()
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for start, length in sorted(pieces):
            assert start == end
            end += length
        assert end <= 64
    assert len(by) <= 1.1 * sum(w[2] for w in want) / 64 + 1
    assert pack_documents(docs.limit(0), PATH).collect() == []


def test_every_old_letter(spark):
    """All code points below U+0250, alone and in words; some lower-case letters are more than one letter."""
    texts = ["Ankara ve İstanbul arası", "İİ, ab'İ"]
    for i in range(1, 0x250):
        texts.append(" ".join([chr(i), chr(i) * 2, f"ab{chr(i)}", f"{chr(i)}stan", f"{chr(i)}x.", f"a{chr(i)}b,"]))
    texts.append("q" * 5000 + " " + "İ" * 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start): r for r in pack_documents(docs, PATH).collect()}
    lib = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert all(got[i, s].ids_crc32 == zlib.crc32(ids[s:s + 2048].tobytes()) for s in range(0, len(ids), 2048)), t
