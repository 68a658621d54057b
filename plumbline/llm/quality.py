"""Quality classifier: naive Bayes support vectors over indicators of hashed n-grams.

An n-gram indicator is scaled by the log ratio of its counts in the two classes; a linear hinge-loss model is fitted on
that by dual coordinate descent and its margin is mapped to a probability on folds it has not seen. The n-grams are
those of words' shapes (runs of small letters, capitals, digits, a sign; and whether a word repeats the one before)
and single words. Every word of a text is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import pieces, release, strings, unused
from .text import SPACE, join, mix, words

FEATURES = 1 << 18
ORDER = 3


def _classes() -> np.ndarray:
    """Small letters and all beyond ASCII as 'a', capitals as 'A', digits as '0', white space as blanks."""
    out = np.arange(256, dtype=np.uint8)
    out[0x80:] = out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[0x09:0x0E] = 0x20
    return out


_CLASS = _classes()
_PLAIN = np.where(np.arange(256) == 0x20, 0, np.arange(256) + 1).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, and their offsets by text."""
    w = words(data, offsets, SPACE)
    low = int(offsets[0])
    kind = _CLASS[data[low : int(offsets[-1])]]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    edge = offsets[:-1] - low
    new[edge[edge < len(new)]] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    s = words(kind[new], upto[offsets - low], _PLAIN)
    n_words = np.diff(w.text)
    owner = np.repeat(np.arange(len(n_words), dtype=np.int64), n_words)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    shape = mix(s.hash + again.astype(np.uint64))
    keys = [(owner << 18) | (mix(w.hash ^ np.uint64(0x77)) >> np.uint64(46)).astype(np.int64)]
    gram = shape
    for n in range(1, ORDER + 1):
        if n > 1:
            gram = join(gram[:-1], shape[n - 1 :]) if len(shape) >= n else gram[:0]
        inside = owner[: len(gram)] == owner[n - 1 :]
        keys.append((owner[: len(gram)] << 18 | (mix(gram + np.uint64(n)) >> np.uint64(46)).astype(np.int64))[inside])
    key = np.unique(np.concatenate(keys))
    return (key & (FEATURES - 1)).astype(np.int32), np.searchsorted(key >> 18, np.arange(len(n_words) + 1))


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        def total(x):
            sums = np.concatenate([[0.0], np.cumsum(x[ids], dtype=np.float64)])
            return sums[ptr[1:]] - sums[ptr[:-1]]

        norm = np.sqrt(np.maximum(total(self.ratio.astype(np.float64) ** 2), 1e-12))
        return np.where(np.diff(ptr) > 0, total(self.weight * self.ratio) / norm, 0.0) + self.bias

    def score(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        z = self.slope * self.margin(ids, ptr) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the bias is a constant feature of value 1."""
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / max(float(np.sqrt(v @ v)), 1e-6))
    square = np.array([float(v @ v) + 1.0 for v in values])
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            slack = y[i] * (weight[r] @ v + bias) - 1
            new = min(max(dual[i] - slack / square[i], 0.0), cost[i])
            step = (new - dual[i]) * y[i]
            if step:
                weight[r] += step * v
                bias += step
                worst = max(worst, abs(step))
                dual[i] = new
        if worst < 1e-3:
            break
    return weight, bias


def _fit_once(rows, y, epochs, seed, c):
    good, bad = np.ones(FEATURES), np.ones(FEATURES)
    for r, label in zip(rows, y):
        (good if label > 0 else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    share = (y > 0).mean()
    cost = np.where(y > 0, c * 0.5 / share, c * 0.5 / (1 - share))
    weight, bias = _hinge(rows, y, ratio, cost, epochs, seed)
    return ratio, weight, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic map, with the usual smoothed targets, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g = np.array([((p - t) * margin).sum() + 1e-6 * a, (p - t).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        size = np.abs(step).max()
        if size > 2:
            step *= 2 / size
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 20, folds: int = 3, c: float = 1.0) -> Model:
    """Rows of feature numbers with 0/1 labels -> model. With fewer than 3 rows of a class there is nothing to
    separate: the score is then the smoothed share of label 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    up, down = int((y > 0).sum()), int((y < 0).sum())
    if min(up, down) < folds:
        p = (up + 1) / (up + down + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(p / (1 - p))))
    fold = np.zeros(len(y), int)
    for side in (y > 0, y < 0):
        fold[side] = np.arange(side.sum()) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = Model(*_fit_once([rows[i] for i in train], y[train], epochs, k, c), 1.0, 0.0)
        own = [rows[i] for i in test]
        ptr = np.concatenate([[0], np.cumsum([len(r) for r in own])])
        margin[test] = part.margin(np.concatenate(own), ptr)
    return Model(*_fit_once(rows, y, epochs, 17, c), *_platt(margin, y))


def train(docs: DataFrame, labelled: DataFrame, most: int = 4_000) -> Model:
    """docs (doc_id, text), labelled (doc_id, label) -> model.

    `most` is the documented bound of the sample: the labelled rows that come first by a hash of their id. They are
    fetched to the driver as feature numbers. Rows whose label is neither 0 nor 1 are no labels.
    """
    chosen = labelled.where("label in (0, 1) and doc_id is not null").groupBy("doc_id", "label").agg(F.xxhash64("doc_id").alias("__place"))
    chosen = chosen.orderBy("__place", "doc_id", "label").limit(most).select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"))
    # at most `most` rows of two numbers
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for a, b in pieces(offsets):
                ids, ptr = features(data, offsets[a : b + 1])
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["doc_id", "label", "ids"])

    got = both.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ids array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    lists = got["ids"].combine_chunks()
    ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return fit(rows, got["label"].to_numpy())


def score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs (doc_id, text, any others) -> the same rows with a score of that name, from the text alone; null counts as
    empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of FEATURES numbers, whatever the input
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(at))
            parts = [held.value.score(*features(data, offsets[a : b + 1])) for a, b in pieces(offsets, 2 << 20)]
            release()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labelled: DataFrame, most: int = 4_000, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (0 to 1), predicted.

    Every document is scored, empty ones and those without an id too; whole texts are read, of any length; repeated rows
    and texts with equal features score alike, and a score that equals the threshold counts as good; an empty table gives
    no rows; without usable labels the score is one half. Other columns are ignored, whatever their names.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labelled, most), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "score", "predicted")


def keep_good(docs: DataFrame, labelled: DataFrame, most: int = 4_000, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least threshold. All columns stay, whatever their names; odd rows count as for
    quality_scores: null and empty texts have the score of a text without features, rows without an id and repeated rows
    are judged by their text, and an empty table gives no rows."""
    (name,) = unused(docs, "score")
    return score(docs, train(docs, labelled, most), name).where(F.col(name) >= threshold).drop(name)
