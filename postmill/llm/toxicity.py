"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector serves all thresholds.  x marks which words and
beginnings of words a text has (hashed to ``BUCKETS`` places).  Labels say toxic or not; toxic training rows get
grade 1 or 2 by how many words of strong evidence they have, against their median.  The severity of a text is its
expected grade.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import labelled_sample, map_texts

BUCKETS = 1 << 18
GRADES = 3
#: Bound of the training sample: labelled rows of each class, whole texts.
SAMPLE_ROWS = 2000
#: Lengths of the beginnings of words that are features besides the words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A feature enters with at least so many training rows, if its toxic share is so many standard errors off the mean.
MIN_ROWS, MIN_Z = 5, 4.0
#: L1 penalty; steps of gradient descent.
PENALTY, STEPS = 1e-4, 1000
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)


def _word_buckets(word: str) -> list[int]:
    return [_bucket(word), *[_bucket("^" + word[:n]) for n in BEGINNINGS if len(word) >= n]]


def _features(text: str | None) -> set[int]:
    return {b for w in set(_WORD.findall((text or "").lower())) for b in _word_buckets(w)}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class OrdinalModel:
    """weights by bucket (zeros left out) and increasing thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self._cache: dict[str, tuple[int, ...]] = {}

    def _known(self, word: str) -> tuple[int, ...]:
        if len(self._cache) > 200_000:
            self._cache.clear()
        self._cache[word] = found = tuple(b for b in _word_buckets(word) if b in self.weights)
        return found

    def grades(self, text: str | None) -> np.ndarray:
        """Probability of each grade."""
        get, new = self._cache.get, self._known
        hit: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            known = get(word)
            if known is None:
                known = new(word)
            if known:
                hit.update(known)
        up = _sigmoid(self.thresholds - sum(self.weights[b] for b in sorted(hit)))
        return np.diff(np.concatenate(([0.0], up, [1.0])))

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "_cache": {}}


def train(sample: list[tuple[str, int]]) -> OrdinalModel:
    """Fit on (text, 0/1) pairs by proximal gradient descent.  Without both classes all weights are zero."""
    ys = np.array([y for _, y in sample])
    if len(set(ys.tolist())) < 2:
        low = -4.0 if len(ys) and ys[0] else 4.0
        return OrdinalModel({}, np.array([low, low + 1]))
    rows = [sorted(_features(t)) for t, _ in sample]
    flat = np.array([b for r in rows for b in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    count = np.bincount(flat, minlength=BUCKETS)
    base = ys.mean()
    share = np.bincount(flat, weights=ys[owner], minlength=BUCKETS) / np.maximum(count, 1)
    z = (share - base) / np.sqrt(base * (1 - base) / np.maximum(count, 1))
    names = np.flatnonzero((count >= MIN_ROWS) & (np.abs(z) >= MIN_Z))
    dense = np.full(BUCKETS, -1)
    dense[names] = np.arange(len(names))
    use = dense[flat] >= 0
    col, owner = dense[flat][use], owner[use]
    seen_toxic = np.bincount(col, weights=ys[owner], minlength=len(names))
    seen = np.bincount(col, minlength=len(names))
    strong = (seen_toxic + 1) / (seen + 2) > base + 0.8 * (1 - base)
    hits = np.bincount(owner, weights=strong[col], minlength=len(rows))
    cut = np.median(hits[ys == 1])
    grade = np.where(ys == 0, 0, np.where(hits > cut, 2, 1))

    w, theta = np.zeros(len(names)), np.array([0.0, 1.5])
    rate, n = 4.0, len(rows)
    for _ in range(STEPS):
        z = np.bincount(owner, weights=w[col], minlength=n)
        up = _sigmoid(theta[None, :] - z[:, None])
        full = np.concatenate([np.zeros((n, 1)), up, np.ones((n, 1))], axis=1)
        lo, hi = full[np.arange(n), grade], full[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        slope_hi, slope_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gz = (slope_hi - slope_lo) / n
        gt = np.array([(slope_lo[grade == k + 1].sum() - slope_hi[grade == k].sum()) / n for k in range(GRADES - 1)])
        w -= rate * np.bincount(col, weights=gz[owner], minlength=len(names))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        theta -= rate * gt
        theta[1] = max(theta[1], theta[0] + 0.05)
    return OrdinalModel({int(b): float(v) for b, v in zip(names, w, strict=True) if v}, theta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model fitted on whole texts of at most ``rows`` labelled rows of each class (see ``labelled_sample``)."""
    return train(labelled_sample(docs, labels, "toxic", rows))


def score_toxicity(docs: DataFrame, model: OrdinalModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) of every row, score (probability of a grade over 0), severity (expected
    grade, 0..2), grade (the most probable one) and toxic (score >= ``THRESHOLD``).

    Null text counts as empty.  Equal texts have equal results, so repeated rows give repeated results; of equally
    probable grades the lowest is given.  Columns that are not kept are not read; an empty table gives an empty result.
    """

    def make():
        def score(texts):
            found = [model.grades(t) for t in texts]
            return [[float(1 - g[0]) for g in found], [float(g @ np.arange(GRADES)) for g in found],
                    [int(g.argmax()) for g in found]]
        return score

    scored = map_texts(docs, keep or ["doc_id"], "score double, severity double, grade int", make)
    return scored.withColumn("toxic", F.col("score") >= THRESHOLD)
