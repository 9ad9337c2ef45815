"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (words; and runs of one to three word shapes: case, digits, trailing signs, length, repetition
of the word before) are scaled by the log ratio of their smoothed counts in the two classes. A linear hinge-loss model
over the scaled, normalised rows is fitted by dual coordinate descent. The margin's logistic value is the score.

The fit reads a bounded sample of labelled documents (`max_docs`, those with the least hashed ids), as a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BASE, SLICE_BYTES, Words, mixed, slices, word_hashes, words

BITS, MAX_DOCS, EPOCHS, COST, ALPHA, SLOPE = 18, 8192, 12, 1.0, 1.0, 4.0


def shapes(w: Words, hashes: np.ndarray) -> np.ndarray:
    """A number per word for how it looks, whatever its letters are."""

    def count(of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(of) + 1, np.int32)
        np.cumsum(of, out=total[1:])
        return total[w.end] - total[w.start]

    b = w.raw
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    sign = (b < 128) & ~upper & ~lower & ~digit
    big, small, signs, digits = count(upper), count(lower), count(sign), count(digit)
    size = w.end - w.start
    last = b[w.end - 1].astype(np.int64) * sign[w.end - 1]
    again = np.zeros(len(size), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    code = upper[w.start] + 2 * ((big > 1) & (small == 0)) + 4 * (digits > 0) + 8 * again + 16 * np.minimum(signs, 3) + 64 * np.minimum(size // 3, 7)
    return code.astype(np.int64) + 512 * last


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, sorted."""
    hashes = word_hashes(w)
    shape = mixed(shapes(w, hashes).astype(np.uint64) + np.uint64(1 << 40))
    found, h = [hashes], np.zeros(len(shape), np.uint64)
    docs = [w.doc]
    for n in range(3):
        m = len(shape) - n
        if m <= 0:
            break
        h = h[:m] * np.uint64(BASE) + shape[n : n + m]
        same = w.doc[:m] == w.doc[n : n + m]
        found.append(mixed(h + np.uint64(n))[same])
        docs.append(w.doc[:m][same])
    key = np.concatenate(docs).astype(np.int64) << bits | (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique(key)
    return key >> bits, key & ((1 << bits) - 1)


def fit_rows(rows: list[np.ndarray], label: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, cost: float = COST, alpha: float = ALPHA) -> np.ndarray:
    """Weights of all features and, last, the bias. One class alone gives a bias towards it; no row gives zeros."""
    width = 1 << bits
    weights = np.zeros(width + 1)
    if len(set(label.tolist())) < 2:
        weights[-1] = 0.0 if not len(label) else (1.0 if label[0] > 0 else -1.0)
        return weights
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, label) if (y > 0) == side] or [np.zeros(0, np.int64)]), minlength=width) + alpha for side in (True, False)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    values = [ratio[r] for r in rows]
    values = [v / max(float(np.sqrt(v @ v)), 1e-9) for v in values]
    side = np.where(label > 0, 1.0, -1.0)
    most = np.where(label > 0, cost * len(label) / (2 * (label > 0).sum()), cost * len(label) / (2 * (label <= 0).sum()))
    dual, w, bias, rng = np.zeros(len(rows)), np.zeros(width), 0.0, np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], values[i], side[i]
            gradient = y * (w[r] @ v + bias) - 1.0
            new = min(max(dual[i] - gradient / 2.0, 0.0), most[i])  # rows have length 1 and a bias of 1
            if new != dual[i]:
                w[r] += (new - dual[i]) * y * v
                bias += (new - dual[i]) * y
                dual[i] = new
    weights[:-1], weights[-1] = w * ratio, bias
    return weights


def learn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS
) -> tuple[np.ndarray, np.ndarray]:
    """(ratio-scaled weights, squared ratios) from at most `max_docs` labelled documents.

    Rows with a null id or label teach nothing; a document with several labels counts with the least one.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "label", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            doc, feature = features(words(b.column(2)))
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "label", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(read, f"id {kind}, label int, features array<int>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label = [], []
        for b in batches:
            label += b.column(1).to_pylist()
            own += [x.values.to_numpy().astype(np.int64) for x in b.column(2)]
        label = np.array(label)
        w = fit_rows(own, label)
        square = np.zeros(1 << BITS)
        if len(set(label.tolist())) == 2:
            sides = [np.bincount(np.concatenate([r for r, y in zip(own, label) if (y > 0) == side]), minlength=1 << BITS) + ALPHA for side in (True, False)]
            square = (np.log(sides[0] / sides[0].sum()) - np.log(sides[1] / sides[1].sum())) ** 2
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([square.astype(np.float32).tobytes()], pa.binary())], names=["weights", "squares"])

    model = rows.repartition(1).sortWithinPartitions("id").mapInArrow(fit, "weights binary, squares binary").first()
    if model is None:
        return np.zeros((1 << BITS) + 1, np.float32), np.zeros(1 << BITS, np.float32)
    return np.frombuffer(model["weights"], np.float32), np.frombuffer(model["squares"], np.float32)


def values(texts: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weights, squares = model
    doc, feature = features(words(texts))
    length = np.sqrt(np.bincount(doc, weights=squares[feature], minlength=len(texts)))
    margin = np.bincount(doc, weights=weights[feature], minlength=len(texts)) / np.maximum(length, 1e-9) + weights[-1]
    return 1.0 / (1.0 + np.exp(-SLOPE * margin))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted), one row per input row; only the text is read.

    A null, empty or wordless text has the score of the bias alone. predicted is 1 where score >= 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            found = values(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, whose score is at least 0.5; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            yield b.filter(pa.array(values(b.column(text_col), model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
