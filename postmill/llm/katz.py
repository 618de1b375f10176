"""Katz backoff language model: Good-Turing discounted bigrams over exactly normalised backoff to unigrams.

Tokens are lower-case words and an end of document, which is also the context of the first word.  Everything that
belongs to one context lives in one table partition (its bucket, by hash of the context): bigram counts, the count of
the context itself, its backoff weight, and the occurrences that are to be scored.  What a bucket needs from others
are the unigram counts of the words that follow its contexts; it asks their buckets once for each distinct word.
A frequent context (``HOT_SHARE`` of the tokens) is dealt over all buckets by the word that follows; its count and the
sums of its weight are added up over the buckets, a few numbers for each of at most 1 / ``HOT_SHARE`` words.

The exchange is built for bytes: a block of documents is turned into arrays of word hashes, sorted by context, and
cut into one compressed piece a bucket, so a token costs a few bytes instead of a row.  Pieces hold distinct bigrams
with the documents they occur in.  Shuffle files are shared by the three passes over the buckets.  A model whose unigram
counts of counts do not allow Good-Turing estimates falls back to absolute discounting for those counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import partitions, small_batches

#: Counts up to K are discounted.
K = 5
#: Tokens of one block.
BLOCK_TOKENS = 1_000_000
#: Logarithms are rounded to 1 / ``STEPS``, so sums over tokens are exact and do not depend on their order.
STEPS = 1e7
#: Contexts with at least this share of the tokens are dealt over the buckets.  One document in ``HOT_SAMPLE`` is
#: counted to find them; which ones are found decides where they are processed, and no result.
HOT_SHARE, HOT_SAMPLE = 1 / 512, 64
END = xxhash.xxh64_intdigest(b" ", 42)  # no word holds a blank


# -- discounts -------------------------------------------------------------------------------------------------

def discounts(n: np.ndarray) -> np.ndarray:
    """d_0..d_K from counts of counts n[0..K+1] (n[0] unused): Good-Turing, absolute where that is not in (0, 1]."""
    n = [float(x) for x in n]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    out = [1.0]
    for r in range(1, K + 1):
        d = -1.0
        if n[r] and tail < 1:
            d = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail)
        out.append(d if 0 < d <= 1 else 1 - absolute / r)
    return np.array(out)


class Model:
    """Global numbers: tokens N, types V, discounts of unigrams and bigrams, probability of an unknown word.

    ``hot``: sorted hashes of the frequent contexts, whose counts are the end of ``stats``.
    """

    def __init__(self, stats: np.ndarray, hot: np.ndarray):
        self.hot, self.hot_count = hot, stats[WIDTH:].copy()
        self.hot_mass, self.hot_lower = np.zeros(len(hot)), np.zeros(len(hot))
        uni = stats[2:2 + K + 2] + np.array([0, *[int((self.hot_count == r).sum()) for r in range(1, K + 2)]])
        self.tokens, self.types = int(stats[0]), int(stats[1]) + int((self.hot_count > 0).sum())
        self.uni, self.bi = discounts(uni), discounts(stats[2 + K + 2:WIDTH])
        lost = sum((1 - self.uni[r]) * r * float(uni[r]) for r in range(1, K + 1))
        least = 1 / (self.tokens + 1)
        unknown = lost / self.tokens if self.tokens else 1.0
        self.scale = 1.0
        if unknown < least:  # nothing was discounted: make room for unknown words
            self.scale, unknown = (1 - least) / (1 - unknown) if unknown < 1 else 1.0, least
        self.unknown = unknown
        self.base = self.tokens + 0.5 * (self.types + 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Probability of words with these counts (0: of the unknown word)."""
        d = self.uni[np.where(count <= K, count, 0)]
        return np.where(count > 0, self.scale * d * count / max(1, self.tokens), self.unknown)


#: tokens, types, and counts of counts 0..K+1 of unigrams and of bigrams
WIDTH = 2 + 2 * (K + 2)


# -- pieces ----------------------------------------------------------------------------------------------------

def _packed(*arrays: np.ndarray) -> bytes:
    small = []
    for a in arrays:
        if a.dtype != np.uint64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)
        planes = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype.itemsize > 1 and a.dtype != np.uint64 else a.tobytes()
        small.append((a.dtype.str, len(a), planes))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small, 5))


def _unpacked(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        if size > 1 and np.dtype(kind) != np.uint64:
            raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).tobytes()
        out.append(np.frombuffer(raw, kind))
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash's upper half, so sorted hashes are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)


def _places(hashes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted ``hot`` ones, and their places there."""
    if not len(hot):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    return hot[at] == hashes, at


def block_pieces(ids: list[np.ndarray], hashes: np.ndarray, train: list[bool], buckets: int,
                 hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, piece) of a block: each document's tokens as places in ``hashes``, the end (place 0) last, and
    whether it is trained on."""
    sizes = np.array([len(t) for t in ids])
    by_hash = np.argsort(hashes)
    words, rank = hashes[by_hash], np.empty(len(hashes), np.uint64)
    rank[by_hash] = np.arange(len(hashes), dtype=np.uint64)
    token = rank[np.concatenate(ids)]
    key = np.roll(token, 1)
    key[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = rank[0]
    key <<= np.uint64(32)
    key |= token
    order = np.argsort(key, kind="stable")
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)[order]
    key = key[order]
    starts = _runs(key)
    type_key = key[starts]
    type_n = np.diff(np.append(starts, len(key)))
    type_ctx = (type_key >> np.uint64(32)).astype(np.int64)
    type_word = (type_key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    flags = np.array(train, np.uint8)
    place = words[type_ctx]
    dealt = _places(words, hot)[0][type_ctx]
    place[dealt] = words[type_word[dealt]] ^ (place[dealt] * _MIX)
    type_bucket = bucket_of(place, buckets)
    order = np.argsort(type_bucket, kind="stable")  # contexts stay sorted within a bucket
    type_ctx, type_word, type_bucket, sizes = type_ctx[order], type_word[order], type_bucket[order], type_n[order]
    ends = np.cumsum(sizes)
    doc = doc[np.repeat(starts[order] - (ends - sizes), sizes) + np.arange(len(doc))]
    for s in _runs(type_bucket):
        b = int(type_bucket[s])
        e = int(np.searchsorted(type_bucket, b, side="right"))
        ctx_at = _runs(type_ctx[s:e])
        seconds, second_id = np.unique(type_word[s:e], return_inverse=True)
        yield b, _packed(
            words[type_ctx[s:e][ctx_at]], np.diff(np.append(ctx_at, e - s)), words[seconds], second_id,
            sizes[s:e], doc[ends[s] - sizes[s]:ends[e - 1]], np.packbits(flags), np.array([len(ids)]))


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Piece:
    """One piece, opened: first and second hash, training count and number of occurrences of each bigram."""

    def __init__(self, data: bytes):
        ctx, ctx_types, seconds, second_id, n, self.doc, bits, size = _unpacked(data)
        self.docs = int(size[0])
        self.train = np.unpackbits(bits)[: self.docs]
        self.first = np.repeat(ctx, ctx_types)
        self.seconds, self.second = seconds, seconds[second_id]
        self.n = n.astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(self.n)[:-1]))
        self.trained = np.add.reduceat(self.train[self.doc].astype(np.int64), starts)


class Bucket:
    """All bigrams of a bucket, merged; with ``only_hot`` those of frequent contexts."""

    def __init__(self, pieces: list[Piece], hot: np.ndarray, only_hot: bool = False):
        first = np.concatenate([p.first for p in pieces])
        second = np.concatenate([p.second for p in pieces])
        trained = np.concatenate([p.trained for p in pieces])
        self.words = np.unique(np.concatenate([p.seconds for p in pieces]))
        self.word_hot, self.word_place = _places(self.words, hot)
        if only_hot:
            keep = _places(first, hot)[0]
            first, second, trained = first[keep], second[keep], trained[keep]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(first) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        self.count = np.add.reduceat(trained[order], start) if len(start) else np.zeros(0, np.int64)
        group = np.zeros(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        self.group, self.first, self.second = group, first[start], second[start]
        self.ctx_start = _runs(self.first)
        self.ctx = np.repeat(np.arange(len(self.ctx_start)), np.diff(np.append(self.ctx_start, len(start))))
        self.contexts = self.first[self.ctx_start]
        self.ctx_hot, self.ctx_place = _places(self.contexts, hot)
        self.hot_size = len(hot)
        self.ctx_count = self._summed(self.count)

    def _summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.ctx_start) if len(self.ctx_start) else values[:0]

    def _of_hot(self, values: np.ndarray) -> np.ndarray:
        """Values of the contexts as values of all frequent ones."""
        out = np.zeros(self.hot_size, values.dtype)
        out[self.ctx_place[self.ctx_hot]] = values[self.ctx_hot]
        return out

    def stats(self) -> np.ndarray:
        """tokens, types, counts of counts 0..K+1 of unigrams, then of bigrams, then counts of the frequent contexts.

        Types and unigrams are those of the other contexts, which lie in one bucket each.
        """
        known = self.ctx_count[(self.ctx_count > 0) & ~self.ctx_hot]
        of = lambda a: [0, *[int((a == r).sum()) for r in range(1, K + 2)]]
        return np.array([self.ctx_count.sum(), len(known), *of(known), *of(self.count), *self._of_hot(self.ctx_count)], np.int64)

    def asked(self) -> np.ndarray:
        return self.words[~self.word_hot]

    def _parts(self, model: Model, answers: np.ndarray):
        """Count of each context, and of each bigram the lower probability and the discounted share, with their sums."""
        word_count = np.zeros(len(self.words), np.int64)
        word_count[~self.word_hot] = answers
        word_count[self.word_hot] = model.hot_count[self.word_place[self.word_hot]]
        lower = model.unigram(word_count[np.searchsorted(self.words, self.second)])
        c1 = self.ctx_count.copy()
        c1[self.ctx_hot] = model.hot_count[self.ctx_place[self.ctx_hot]]
        r = self.count
        d = model.bi[np.where(r <= K, r, 0)]
        seen = np.where(r > 0, d * r / np.maximum(c1[self.ctx], 1), 0.0)
        return c1, lower, seen, self._summed(seen), self._summed(np.where(r > 0, lower, 0.0))

    def hot_sums(self, model: Model, answers: np.ndarray) -> np.ndarray:
        """Discounted mass and lower mass of the bigrams of frequent contexts that lie in this bucket."""
        _, _, _, mass, low = self._parts(model, answers)
        return np.concatenate((self._of_hot(mass), self._of_hot(low)))

    def probabilities(self, model: Model, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each bigram, and the count of each context.

        ``answers``: training counts of the words that were asked for.
        """
        c1, lower, seen, mass, low = self._parts(model, answers)
        mass[self.ctx_hot] = model.hot_mass[self.ctx_place[self.ctx_hot]]
        low[self.ctx_hot] = model.hot_lower[self.ctx_place[self.ctx_hot]]
        rest = 1 - low
        least = 1 / (c1 + 1.0)
        left = np.maximum(1 - mass, least)  # a context without discounted mass gives a little to unseen words
        scale = np.where(mass > 0, (1 - left) / np.maximum(mass, 1e-300), 1.0)
        weight = np.where(c1 > 0, left / np.maximum(rest, 1e-300), 1.0)
        p = np.where(self.count > 0, seen * scale[self.ctx], weight[self.ctx] * lower)
        return np.log10(p), c1


# -- passes over the buckets -----------------------------------------------------------------------------------

def _place(bucket: int) -> int:
    return bucket


def _sorted_out(records: Iterable) -> dict[int, dict[str, list]]:
    found: dict[int, dict[str, list]] = {}
    for bucket, (kind, value) in records:
        found.setdefault(bucket, {}).setdefault(kind, []).append(value)
    return found


def _ask(buckets: int, hot: np.ndarray):
    def run(records):
        for b, kinds in _sorted_out(records).items():
            if "piece" not in kinds:
                continue
            bucket = Bucket([Piece(x[1]) for x in kinds["piece"]], hot)
            yield b, ("stats", bucket.stats())
            asked = bucket.asked()
            to = bucket_of(asked, buckets)
            for s in _runs(to):
                e = int(np.searchsorted(to, to[s], side="right"))
                yield int(to[s]), ("ask", (b, _packed(asked[s:e])))
    return run


def _answer(records):
    for b, kinds in _sorted_out(records).items():
        if "ask" not in kinds:
            continue
        ctx, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, data in kinds.get("piece", []):
            piece = Piece(data)
            starts = _runs(piece.first)
            ctx.append(piece.first[starts])
            count.append(np.add.reduceat(piece.trained, starts))
        words, at = np.unique(np.concatenate(ctx), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(count), minlength=len(words)).astype(np.int64)
        words, total = np.append(words, np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(total, 0)
        for asker, data in kinds["ask"]:
            wanted, = _unpacked(data)
            i = np.searchsorted(words, wanted)
            yield asker, ("answer", (b, _packed(np.where(words[i] == wanted, total[i], 0))))


def _answered(kinds: dict[str, list]) -> np.ndarray:
    answers = dict(kinds.get("answer", []))
    return np.concatenate([np.zeros(0, np.int64), *[_unpacked(answers[b])[0].astype(np.int64) for b in sorted(answers)]])


def _hot_sums(model: Model):
    def run(records):
        for _, kinds in _sorted_out(records).items():
            if "piece" in kinds:
                yield Bucket([Piece(x[1]) for x in kinds["piece"]], model.hot, True).hot_sums(model, _answered(kinds))
    return run


def _score(model: Model):
    def run(records):
        for _, kinds in _sorted_out(records).items():
            for block, data in kinds.get("meta", []):
                yield block, ("meta", data)
            if "piece" not in kinds:
                continue
            pieces = [Piece(x[1]) for x in kinds["piece"]]
            bucket = Bucket(pieces, model.hot)
            logs, counts = bucket.probabilities(model, _answered(kinds))
            own, logs = np.rint(np.log10((counts + 0.5) / model.base) * STEPS), np.rint(logs * STEPS)
            at = 0
            for (block, _), piece in zip(kinds["piece"], pieces, strict=True):
                group = np.repeat(bucket.group[at:at + len(piece.n)], piece.n)
                at += len(piece.n)
                sums = [np.bincount(piece.doc, weights=w, minlength=piece.docs) for w in (
                    own[bucket.ctx[group]], logs[group], counts[bucket.ctx[group]] > 0)]
                some = np.unique(piece.doc)
                yield block, ("sum", (some.astype(np.uint32), *[s[some] for s in sums[:2]], sums[2][some].astype(np.uint32)))
    return run


def _rows(tokens: int):
    def run(records):
        for _, kinds in _sorted_out(records).items():
            for data in kinds.get("meta", []):
                ids, counts = pickle.loads(data)
                base, score, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                for some, b, s, k in sorted(kinds.get("sum", []), key=lambda x: float(x[2][0])):
                    base[some] += b
                    score[some] += s
                    known[some] += k
                for i, n, k, b, s in zip(ids, counts, known.tolist(), (base / STEPS).tolist(), (score / STEPS).tolist(), strict=True):
                    yield i, n, k, tokens, b, s
    return run


def frequent_contexts(docs: DataFrame, share: float = HOT_SHARE, sample: int = HOT_SAMPLE) -> np.ndarray:
    """Sorted hashes of the words with at least ``share`` of the tokens of a sample of the documents, and of the end."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(F.translate("text", upper, upper.lower()), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = some.select(F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.filter(F.col("n") >= max(1.0, share * total)).collect()  # at most 1 / share
    return np.array(sorted({END, *[r["h"] % (1 << 64) for r in found]}), np.uint64)


def score_documents(docs: DataFrame, train: str = "train") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text, ``train``).

    Rows whose ``train`` is true are learned from; null is false.  Null text counts as empty and has one token, the
    end.  base_score is the add-half unigram score, score the model's log10 probability of the text, each a sum of
    logarithms to seven places; an unknown word has the probability of all unknown words.  Repeated rows count and are scored each; other columns are not read;
    an empty table gives an empty result.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    given = docs.select("doc_id", "text", F.coalesce(F.col(train), F.lit(False)).alias("train"))

    def blocks(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        digest = xxhash.xxh64_intdigest
        names, tokens, flags, held = [], [], [], 0
        vocabulary: dict[bytes, int] = {b" ": 0}

        def finish():
            block = task << 24 | made
            hashes = np.array([digest(w, 42) for w in vocabulary], np.uint64)
            out = [(block % buckets, "meta", block, pickle.dumps((names, [len(t) for t in tokens]), 5))]
            for b, data in block_pieces(tokens, hashes, flags, buckets, hot):
                out.append((b, "piece", block, data))
                if len(out) == 8:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(column) for column in zip(*rows, strict=True)], ["bucket", "kind", "block", "data"])

        for batch in batches:
            for i, t, f in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "train")], strict=True):
                words = (t or "").encode("utf-8", "replace").lower().split()
                for w in set(words).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                ids = np.zeros(len(words) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words))
                names.append(i)
                tokens.append(ids)
                flags.append(f)
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield from finish()
                    names, tokens, flags, held, made = [], [], [], 0, made + 1
                    vocabulary = {b" ": 0}
        if names:
            yield from finish()

    rows = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not given.take(1):
        return spark.createDataFrame([], rows)
    hot = frequent_contexts(given, HOT_SHARE, HOT_SAMPLE)
    packed = given.mapInArrow(blocks, "bucket long, kind string, block long, data binary")
    spread = packed.rdd.map(lambda r: (r[0], (r[1], (r[2], bytes(r[3]))))).partitionBy(buckets, _place)
    asked = spread.mapPartitions(_ask(buckets, hot)).partitionBy(buckets, _place)
    add = lambda a, b: a + b
    stats = asked.filter(lambda x: x[1][0] == "stats").map(lambda x: x[1][1]).fold(np.zeros(WIDTH + len(hot), np.int64), add)
    model = Model(stats, hot)
    answered = spread.union(asked).mapPartitions(_answer).partitionBy(buckets, _place)
    ready = spread.union(answered)
    sums = ready.mapPartitions(_hot_sums(model)).fold(np.zeros(2 * len(hot)), add)
    model.hot_mass, model.hot_lower = sums[:len(hot)], sums[len(hot):]
    scored = ready.mapPartitions(_score(model)).partitionBy(buckets, _place)
    return spark.createDataFrame(scored.mapPartitions(_rows(model.tokens)), rows)
