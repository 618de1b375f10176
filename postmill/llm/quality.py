"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it.  ``FILTERS`` learned filters of
``WIDTH`` bytes slide over each chunk (a filter is a table of weights by place and byte), their responses pass a
rectifier and are max-pooled over the chunk and then over the chunks; a logistic layer makes one probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import labelled_sample, map_texts

FILTERS, WIDTH, CHUNK = 16, 5, 4096
#: Bound of the training sample: labelled rows of each class, whole texts.
SAMPLE_ROWS = 900
EPOCHS, BATCH, RATE = 8, 16, 0.02
THRESHOLD = 0.3


def _bytes(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "replace")
    return np.frombuffer(data + b"\0" * max(0, WIDTH - len(data)), np.uint8)


class ByteConvNet:
    """Weights: tables (WIDTH, 256, FILTERS), bias, output weights and output bias."""

    def __init__(self, tables, bias, out, out_bias):
        self.tables, self.bias, self.out, self.out_bias = tables, bias, out, float(out_bias)

    def _responses(self, x: np.ndarray) -> np.ndarray:
        m = len(x) - WIDTH + 1
        acc = np.take(self.tables[0], x[:m], axis=0)
        for k in range(1, WIDTH):
            acc += np.take(self.tables[k], x[k:k + m], axis=0)
        return acc

    def pooled(self, x: np.ndarray, where: bool = False):
        """Largest response of each filter over all chunks, and with ``where`` its position."""
        best, place = None, None
        for start in range(0, max(1, len(x) - WIDTH + 1), CHUNK - WIDTH + 1):
            r = self._responses(x[start:start + CHUNK])
            top = r.max(axis=0)
            if where:
                at = r.argmax(axis=0) + start
                place = at if best is None else np.where(top > best, at, place)
            best = top if best is None else np.maximum(best, top)
        return np.maximum(best + self.bias, 0), place

    def score(self, text: str | None) -> float:
        h, _ = self.pooled(_bytes(text))
        return float(1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30))))


def train(sample: list[tuple[str, int]], seed: int = 7) -> ByteConvNet:
    """Fit by Adam on (text, 0/1) pairs; deterministic.  No rows, or one class only, give a constant score."""
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
    net = ByteConvNet(tables, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        net.out[:], net.out_bias = 0, 4.0 * (2 * ys[0] - 1) if ys else 0.0
        return net
    data = [(_bytes(t), y) for t, y in sample]
    slots = [net.tables, net.bias, net.out, np.zeros(1, np.float32)]
    m1, m2 = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots]
    step, cols = 0, np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for b in range(0, len(order), BATCH):
            grads = [np.zeros_like(s) for s in slots]
            for i in order[b:b + BATCH]:
                x, y = data[i]
                h, at = net.pooled(x, where=True)
                p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
                d = np.float32((p - y) / BATCH)
                grads[2] += d * h
                grads[3] += d
                back = d * net.out * (h > 0)
                grads[1] += back
                for k in range(WIDTH):
                    grads[0][k, x[at + k], cols] += back
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for s, g, a, v in zip(slots, grads, m1, m2, strict=True):
                g += 1e-5 * s
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                s -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.out_bias = float(slots[3][0])
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteConvNet:
    """A network fitted on whole texts of at most ``rows`` labelled rows of each class (see ``labelled_sample``)."""
    return train(labelled_sample(docs, labels, "quality", rows))


def score_quality(docs: DataFrame, net: ByteConvNet, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) of every row, score in 0..1 (higher: label 1 likelier) and predicted.

    Null text counts as empty and gets the score of an all-zero input.  Equal texts have equal scores, so repeated
    rows give repeated results; a score of exactly ``THRESHOLD`` predicts 1.  Columns that are not kept are not read;
    an empty table gives an empty result.
    """
    scored = map_texts(docs, keep or ["doc_id"], "score double", lambda: lambda texts: [[net.score(t) for t in texts]])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
