"""Quality score by hashed word n-grams and logistic regression, learnt with
follow-the-regularised-leader updates.

Features are hashed into 2**``bits`` cells: the words and pairs of words of a
text, and the shapes and pairs of shapes of its words (letters, digits and each
symbol, runs taken once, so that ``word!!`` and ``other!!`` share one). Each kind
counts as shares of the text, times ``scale``. A score is the logistic of a
sparse dot product: every cell of the text times its weight.

The model is fitted on at most ``max_rows`` labelled rows, the first by a hash
of their id; every other step covers all rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import units


@dataclass(frozen=True)
class Params:
    bits: int = 18
    scale: float = 8.0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 4
    max_rows: int = 8000


# Shape of a byte: lower case, upper case, digit, longer code point, or itself.
_SHAPE = np.array([
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 195 if b >= 128 else b for b in range(256)
], dtype=np.uint8)


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def features(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, values, first feature of each row); a cell may come repeatedly."""
    data, offsets = units.column_bytes(column)
    starts, ends, first = units.words(data, offsets, units.NO_SPACE)
    hashes = units.ranges(units.running(data), starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    # The last byte of a word's shape is the last kept one before its end.
    shapes = units.ranges(units.running(shape[keep]), place[starts], place[ends]) if len(starts) else hashes
    rows = np.diff(first)
    row = np.repeat(np.arange(len(rows)), rows)
    kinds = []
    for salt, h in ((1, hashes), (2, shapes)):
        kinds.append((row, units.mix(h + np.uint64(salt))))
        inner = row[1:] == row[:-1]
        pair = units.mix(h[:-1] * np.uint64(units.BASE) + units.mix(h[1:] + np.uint64(salt + 2)))
        kinds.append((row[1:][inner], pair[inner]))
    of = np.concatenate([r for r, _ in kinds])
    cells = (np.concatenate([h for _, h in kinds]) >> np.uint64(64 - p.bits)).astype(np.int64)
    share = np.concatenate([p.scale / np.bincount(r, minlength=len(rows))[r] for r, _ in kinds])
    order = np.argsort(of, kind="stable")
    return cells[order], share[order], np.searchsorted(of[order], np.arange(len(rows) + 1))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; the last cell is the bias."""

    def __init__(self, p: Params):
        self.p, size = p, (1 << p.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, p = self.z[cells], self.p
        step = (p.beta + np.sqrt(self.n[cells])) / p.alpha + p.l2
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / step)

    def learn(self, cells: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(cells)
        g = (_sigmoid(float(w @ values)) - label) * values
        sigma = (np.sqrt(self.n[cells] + g * g) - np.sqrt(self.n[cells])) / self.p.alpha
        self.z[cells] += g - sigma * w
        self.n[cells] += g * g


def _merged(cells: np.ndarray, values: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    own, which = np.unique(cells, return_inverse=True)
    return np.append(own, 1 << p.bits), np.append(np.bincount(which, weights=values, minlength=len(own)), 1.0)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> np.ndarray:
    """Weights of all cells and the bias, from rows of ``docs`` (doc_id, text)
    that ``labels`` (doc_id, quality) has. Without labels all weights are 0.

    Labels of an id that differ count as 0; a null label or id is no label.
    """
    picked = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    )
    told = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_rows rows

    def run(batches):
        rows: list = []
        for batch in batches:
            for part in units.slices(batch):
                cells, values, first = features(part.column("text"), p)
                for i, label in enumerate(part.column("label").to_pylist()):
                    own, share = _merged(cells[first[i] : first[i + 1]], values[first[i] : first[i + 1]], p)
                    rows.append((own.astype(np.int32), share.astype(np.float32), int(label)))
        model = Ftrl(p)
        for epoch in range(p.epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                cells, values, label = rows[k]
                model.learn(cells, values.astype(np.float64), label)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(model.weights().astype("<f4").tobytes())], pa.binary())], ["weights"])

    told = told.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    fitted = told.select("text", "label").mapInArrow(run, "weights binary").head()
    if fitted is None:
        return np.zeros((1 << p.bits) + 1)
    return np.frombuffer(zlib.decompress(bytes(fitted["weights"])), "<f4").astype(np.float64)


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, p: Params = Params()) -> DataFrame:
    """(doc_id, score, predicted) of every row; a text without words has the
    bias alone as its features."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 * 2**bits bytes

    def run(batches):
        w = sent.value
        for batch in batches:
            for part in units.slices(batch):
                cells, values, first = features(part.column("text"), p)
                sums = np.concatenate([[0.0], np.cumsum(w[cells] * values)])
                score = _sigmoid(sums[first[1:]] - sums[first[:-1]] + float(w[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id,
    text). One id in five is held out and never learnt from.

    A null text is empty. A null doc_id is not held out and never labelled.
    Repeated rows score alike. An empty table gives an empty result; other
    columns are ignored.
    """
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    weights = fit(docs, labels.where(~held), p)
    return scored(docs, weights, p=p).select("doc_id", held.alias("held_out"), "score", "predicted")
