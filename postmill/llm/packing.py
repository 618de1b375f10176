"""Packing token sequences into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; the rest of each document is one piece.  Pieces of one length
are alike, so the plan needs only how many pieces of each length there are (at most ``window`` numbers).  On the
driver a segment tree indexed by remaining capacity finds the tightest open windows for one length after another,
whole groups of equal windows at a time; the work depends on the window size and not on the number of documents.
The pieces then look up their places: each has a rank among those of its length, and the plan maps ranges of ranks
to windows and offsets.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.bpe import KEEP_CHARS, cut_white
from postmill.llm.common import partitions, saved, small_batches

WINDOW, END_ID = 2048, 1
#: Entries of a worker's cache of encoded chunks (white-space separated parts of texts).
CACHE = 1_500_000


class CapacityTree:
    """Segment tree over remaining capacities 0..n: counts groups, finds the smallest capacity >= a value."""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i //= 2

    def first(self, least: int) -> int | None:
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(sizes: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Plan for ``sizes`` (length -> number of pieces).

    Rows (length, first rank, last rank, pieces a window, first window, first offset): rank i of a row goes to
    window first + (i - first rank) // per window, after (i - first rank) % per window others of its row.
    """
    tree, groups = CapacityTree(window), [[] for _ in range(window + 1)]
    plan, windows = [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            groups[capacity].append((first, count))
            tree.add(capacity, 1)

    for length in sorted(sizes, reverse=True):
        left, rank = sizes[length], 0
        while left:
            capacity = tree.first(length)
            if capacity is None:
                capacity, first, count = window, windows, -(-left // (window // length))
                windows += count
            else:
                first, count = groups[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            full = min(count, left // each)
            rest = min(left - full * each, each - 1) if full < count else 0
            if full:
                plan.append((length, rank, rank + full * each - 1, each, first, window - capacity))
                put(capacity - each * length, first, full)
            if rest:
                plan.append((length, rank + full * each, rank + full * each + rest - 1, rest, first + full, window - capacity))
                put(capacity - rest * length, first + full, 1)
            put(capacity, first + full + (rest > 0), count - full - (rest > 0))
            rank += full * each + rest
            left -= full * each + rest
    return plan


def _encoded(lib, final: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of words of letters.  Many are encoded as one text: each ends with the next token that ends a word."""
    out = []
    for k in range(0, len(words), 2000):
        part = words[k:k + 2000]
        e = lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
        ids = np.array(e.ids, "<u4")
        ends = (4 * (np.flatnonzero(final[ids]) + 1)).tolist()
        if len(ends) == len(part):
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        else:  # the vocabulary cuts one of them after all
            out += [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(part, add_special_tokens=False)]
    return out


def letters_only(chunk: str) -> bool:
    """Whether a chunk is one word to the vocabulary: its normal form, composed and in lower case, is all letters.

    The dotted capital I is a letter whose lower case is a letter and a mark, for example.
    """
    return chunk.isalpha() and (chunk.isascii() or unicodedata.normalize("NFC", chunk).lower().isalpha())


def _learn(lib, final: np.ndarray, cache: dict[str, bytes], plain: set[str], rare: set[str]) -> list[str]:
    """Encode chunks into the cache; returns the new ones that are too long to be kept.

    Letters before one mark are a word and a mark for the vocabulary's pattern, so such chunks are put together from
    both; not so ``rare`` ones, of texts with characters outside of the old blocks of Unicode, where libraries may
    differ on what is a letter.
    """
    if len(cache) > CACHE:
        cache.clear()
    words, others, double = set(), set(rare), []
    for c in plain.difference(cache):
        if letters_only(c):
            words.add(c)
        elif c[-1].isascii() and not c[-1].isalnum() and letters_only(c[:-1]):
            double.append(c)
            words.add(c[:-1])
            others.add(c[-1])
        else:
            others.add(c)
    new = list(words.difference(cache))
    long = [c for c in new if len(c) > KEEP_CHARS]
    cache.update(zip(new, _encoded(lib, final, new), strict=True))
    new = list(others.difference(cache))
    long += [c for c in new if len(c) > KEEP_CHARS]
    for c, e in zip(new, lib.encode_batch_fast(new, add_special_tokens=False), strict=True):
        cache[c] = np.array(e.ids, "<u4").tobytes()
    for c in double:
        cache[c] = cache[c[:-1]] + cache[c[-1]]
    return long + [c for c in double if len(c) > KEEP_CHARS]


_RARE = re.compile("[\u0250-\U0010ffff]")
_TOKENIZERS: dict[int, tuple] = {}


def _tokenizer(spec: str):
    """The library's tokenizer, which tokens end a word, and a cache of encoded chunks; kept in the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(spec)
    if key not in _TOKENIZERS:
        lib = Tokenizer.from_str(spec)
        lib.no_padding()
        lib.no_truncation()
        vocabulary = lib.get_vocab()
        final = np.zeros(max(vocabulary.values()) + 1, bool)
        final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        _TOKENIZERS[key] = (lib, final, {})
    return _TOKENIZERS[key]


def token_pieces(docs: DataFrame, spec_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the windows that each row's ids (and the end id) are cut into.

    Null text counts as empty and has the end id alone.  Repeated rows give repeated pieces; other columns are not
    read; an empty table gives an empty result.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    with open(spec_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        lib, final, cache = _tokenizer(spec.value)
        # a chunk between blanks is encoded alone; texts that may hold special tokens are encoded whole
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            # lower case makes no difference to the vocabulary, but fewer chunks
            chunks = [None if "<|" in t else cut_white(t.lower() if t.isascii() else t) for t in texts]
            odd = [not t.isascii() and _RARE.search(t) is not None for t in texts]
            long = _learn(lib, final, cache, set().union(*[c for c, o in zip(chunks, odd, strict=True) if c and not o]),
                          set().union(*[c for c, o in zip(chunks, odd, strict=True) if c and o]))
            gc.freeze()  # what the cache holds has no cycles; collections need not walk through it
            out: list[list] = [[], [], [], [], []]
            for i, t, c in zip(batch.column("doc_id").to_pylist(), texts, chunks, strict=True):
                if c is None:
                    data = np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + last
                else:
                    data = b"".join(map(cache.__getitem__, c)) + last
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start:4 * (start + window)]
                    for column, value in zip(out, (i, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            for c in long:
                cache.pop(c, None)
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field("doc_id").type if k == 0 else pa.int64())
                                              for k, v in enumerate(out)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with sequence_id and offset; lengths lie in 1..window.

    Each piece gets one place; places in a sequence are gapless from 0.  Null doc_ids are packed like others;
    repeated rows get a place each; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(2 * partitions(spark)))
    given = saved(pieces.withColumn("_salt", salt))
    counts = given.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = best_fit_decreasing(sizes, window)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    ranked = (
        given.withColumn("_i", F.row_number().over(own) - 1)
        .join(offsets, ["length", "_salt"])
        .withColumn("_rank", F.col("_i") + F.col("_before"))
    )
    places = spark.createDataFrame(
        plan, "length long, _from long, _to long, _each long, _window long, _offset long")
    at = F.col("_rank") - F.col("_from")
    # the plan's size depends on the window only, so it can be broadcast
    return (
        ranked.join(F.broadcast(places), "length")
        .filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") <= F.col("_to")))
        .select(
            *[c for c in pieces.columns],
            (F.col("_window") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, spec_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenise every row of ``docs`` (null text counts as empty: only the end id) and pack all pieces."""
    return pack(token_pieces(docs, spec_path, window, end_id), window)
