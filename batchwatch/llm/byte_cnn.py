"""Quality classifier: a byte-level convolutional network in numpy.

Filters look at windows of ``WIDTH`` bytes, one every ``STRIDE`` bytes, so windows overlap and cover the
whole text.  Their activations are max-pooled over chunks of ``CHUNK`` windows; the mean and the maximum of
the pooled values over all chunks give one probability, along with the share of the first chunk that a
short text leaves empty (fewer windows have lower maxima).  The text is never shortened.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import held_out, sample_per_class
from .words import utf8

WIDTH, STRIDE, CHUNK, FILTERS = 8, 2, 128, 32
#: bound of the labelled sample: rows per class
TRAIN_ROWS = 600
STEPS, DOCS_PER_STEP, RATE, DECAY = 300, 48, 0.01, 1e-3
#: share of each draw with label 1
POSITIVE = 2 / 3
THRESHOLD = 0.3
#: chunks whose activations are in memory at once
_SLAB = 512


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts; where each chunk starts; chunks and unfilled share per text).

    A text is filled up with zeros to whole chunks and a gap for the windows at its end, so no window meets the
    next text.
    """
    span, gap = CHUNK * STRIDE, WIDTH - STRIDE
    unfilled = np.array([1 - min(len(t), span) / span for t in texts], np.float32)
    counts = np.array([-(-len(t) // span) for t in texts], np.int64)
    joined = b"".join(t + bytes(c * span + gap - len(t)) for t, c in zip(texts, counts.tolist()))
    owner = np.repeat(np.arange(len(texts)), counts)
    return np.frombuffer(joined, np.uint8), np.arange(counts.sum()) * span + owner * gap, counts, unfilled


class ByteNet:
    """Weights: one row per filter place and byte value, a bias per filter, and the last layer."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.filters = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.last = (rng.standard_normal(2 * FILTERS + 1) * 0.1).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def activations(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(chunks, CHUNK, FILTERS) of the chunks that start at ``starts``."""
        windows = (starts[:, None] + np.arange(CHUNK) * STRIDE).ravel()
        total = self.filters[0].take(data.take(windows), axis=0)
        part = np.empty_like(total)
        for k in range(1, WIDTH):
            np.take(self.filters[k], data.take(windows + k), axis=0, out=part, mode="clip")
            total += part
        return total.reshape(len(starts), CHUNK, FILTERS)

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), FILTERS), np.float32)
        for at in range(0, len(starts), _SLAB):
            out[at:at + _SLAB] = self.activations(data, starts[at:at + _SLAB]).max(axis=1)
        return out

    def combine(self, hidden: np.ndarray, counts: np.ndarray, unfilled: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each text (zeros for an empty text), unfilled share."""
        out = np.zeros((len(counts), 2 * FILTERS + 1), np.float32)
        out[:, -1] = unfilled
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            out[some, :FILTERS] = np.add.reduceat(hidden, starts, axis=0) / counts[some, None]
            out[some, FILTERS:-1] = np.maximum.reduceat(hidden, starts, axis=0)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        data, starts, counts, unfilled = chunked([utf8(t) for t in texts])
        hidden = np.maximum(self.pooled(data, starts) + self.bias, 0)
        # summed row by row: a matrix product may round a row by its place in the batch
        logit = (self.combine(hidden, counts, unfilled) * self.last).sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def step(self, texts: list[bytes], truth: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted logistic loss for non-empty texts."""
        data, starts, counts, unfilled = chunked(texts)
        chunks = len(starts)
        peak = np.empty((chunks, FILTERS), np.int64)
        hidden = np.empty((chunks, FILTERS), np.float32)
        for at in range(0, chunks, _SLAB):
            active = self.activations(data, starts[at:at + _SLAB])
            peak[at:at + _SLAB] = active.argmax(axis=1)
            hidden[at:at + _SLAB] = np.take_along_axis(active, peak[at:at + _SLAB, None], 1)[:, 0]
        hidden += self.bias
        np.maximum(hidden, 0, out=hidden)
        features = self.combine(hidden, counts, unfilled)
        logit = features @ self.last + self.offset
        error = ((1 / (1 + np.exp(-logit)) - truth) * weight).astype(np.float32)
        owner = np.repeat(np.arange(len(counts)), counts)
        back = (error / counts)[owner, None] * self.last[:FILTERS]
        top = hidden == features[owner, FILTERS:-1]
        back = (back + top * error[owner, None] * self.last[FILTERS:-1]) * (hidden > 0)
        window = starts[:, None] + peak * STRIDE
        place = np.arange(FILTERS)
        filters = np.empty_like(self.filters)
        for k in range(WIDTH):
            cell = data[window + k].astype(np.int64) * FILTERS + place
            filters[k] = np.bincount(cell.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return [filters, back.sum(axis=0), error @ features, error.sum(keepdims=True)]


def train(texts: list[str], labels: list[int], seed: int = 1) -> ByteNet:
    """Adam with weight decay on draws with a fixed share of label 1; the same sample gives the same network.

    With fewer than two classes the network only knows their share: every text gets the same score.
    """
    net = ByteNet(seed)
    data, truth = [utf8(t) for t in texts], np.array(labels, np.float32)
    usable = np.array([len(d) > 0 for d in data], bool)
    positive, negative = np.flatnonzero(usable & (truth == 1)), np.flatnonzero(usable & (truth == 0))
    if not len(positive) or not len(negative):
        net.last[:] = 0
        share = (truth.sum() + 0.5) / (len(truth) + 1)
        net.offset[:] = np.log(share / (1 - share))
        return net
    rng = np.random.default_rng(seed)
    weights = [net.filters, net.bias, net.last, net.offset]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    of_positive = round(DOCS_PER_STEP * POSITIVE)
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(positive, of_positive), rng.choice(negative, DOCS_PER_STEP - of_positive)])
        gradients = net.step([data[i] for i in rows], truth[rows], np.full(len(rows), 1 / len(rows)))
        rate = RATE * (1 - step / (STEPS + 1))
        for w, g, m, v in zip(weights, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * ((m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) + DECAY * w)
    return net


def fit(docs: DataFrame, labelled: DataFrame) -> ByteNet:
    """A network for ``labelled`` (doc_id, label 0 or 1); texts come from ``docs`` (doc_id, text)."""
    rows = sample_per_class(labelled, docs, TRAIN_ROWS)
    return train([text for _, _, text in rows], [int(label) for label, _, _ in rows])


def with_score(docs: DataFrame, net: ByteNet, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; null and empty texts get that of an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(name, run(F.col(text)))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows one may learn from.

    Labels other than 0 and 1, and ids with labels that disagree, are left out.
    """
    one = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other"))
    return one.where(~held_out("doc_id", 5, 0) & (F.col("label") == F.col("other"))).select("doc_id", "label")


def good_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a score of at least ``THRESHOLD``; all columns stay."""
    net = fit(docs.select("doc_id", "text"), training_labels(labels))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, net, name=name).where(F.col(name) >= THRESHOLD).drop(name)
