"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each model sees the words and word beginnings of
a text, and the log-odds of the categories before its own; in training these come from models
that haven't seen the row (out of fold), so later models learn from predictions as good as
those they get in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Sparse, lasso_logistic, sigmoid
from .runtime import bounded_batches
from .textscan import LOWER, Hasher, Slice, mix, slices, words

#: The labelled rows a chain is fitted on at most: those with the least hash of doc_id.
SAMPLE_ROWS = 8_000
BUCKET_BITS = 20
STARTS = (4, 5, 6)
FEATURES = 2_048
MIN_DOCS = 4
FOLDS = 3
#: Weight of the L1 penalty, divided by the number of rows.
PENALTY = 0.06
STEPS = 500


def _features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each word and of each word's first 4, 5 and 6 bytes."""
    found = words(part, plain=True)
    hasher = Hasher(LOWER[part.data])
    text, hashes = [found.text], [found.hash]
    for n in STARTS:
        longer = found.end - found.start > n
        start = found.start[longer]
        text.append(found.text[longer])
        hashes.append(mix(hasher.of(start, start + n) + np.uint64(n)))
    return np.concatenate(text), (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the distinct buckets of its text instead of the text."""
    for batch in batches:
        lists: list[np.ndarray] = []
        for part in slices(batch["text"]):
            text, bucket = _features(part)
            both = np.unique(text << BUCKET_BITS | bucket)
            edges = np.searchsorted(both, np.arange(len(part.bounds)) << BUCKET_BITS)
            lists += np.split((both & (1 << BUCKET_BITS) - 1).astype(np.int32), edges[1:-1])
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(lists, pa.list_(pa.int32()))], [*rest, "buckets"])


class Chain(NamedTuple):
    """categories in order; slot of each bucket among the chosen features (-1: none); a model for each category.

    cutoffs: the probability of each category from which on a text belongs to it.
    """

    categories: list[str]
    slot: np.ndarray
    models: list[tuple[float, np.ndarray, np.ndarray]]
    cutoffs: list[float]

    def probabilities(self, part: Slice) -> np.ndarray:
        """A row for each text of the slice, a column for each category."""
        n = len(part.bounds) - 1
        text, bucket = _features(part)
        slot = self.slot[bucket]
        both = np.unique(text[slot >= 0] * FEATURES + slot[slot >= 0])
        text, slot = both // FEATURES, both % FEATURES
        logits = np.zeros((n, 0))
        for intercept, weights, links in self.models:
            z = intercept + np.bincount(text, weights[slot], n) + logits @ links
            logits = np.column_stack([logits, np.clip(z, -10, 10)])
        return sigmoid(logits)


def _cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that divides the classes best (by the F1 measure), amid the gap there."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    k = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(sigmoid((np.log(p[order[k]] / (1 - p[order[k]])) + np.log(max(below, 1e-5) / (1 - min(below, 1 - 1e-5)))) / 2))


class _Rows(NamedTuple):
    """Labelled rows: for each distinct bucket of each text its row and bucket; labels y by category."""

    row: np.ndarray
    bucket: np.ndarray
    y: np.ndarray

    def chosen(self, own: np.ndarray) -> np.ndarray:
        """Slot of each bucket among the features that tell most about some category in the rows ``own`` (-1: none)."""
        mine, y = own[self.row], self.y
        n_docs = np.bincount(self.bucket[mine], minlength=1 << BUCKET_BITS)
        value = np.zeros(1 << BUCKET_BITS)
        for j in range(y.shape[1]):
            inside = np.bincount(self.bucket[mine], y[self.row[mine], j], 1 << BUCKET_BITS)
            share = y[own, j].mean() if own.any() else 0.0
            value = np.maximum(value, np.abs(inside - n_docs * share) / np.sqrt(n_docs * share * (1 - share) + 1))
        value[n_docs < MIN_DOCS] = 0
        best = np.argsort(-value, kind="stable")[:FEATURES]
        best = best[value[best] > 0]
        slot = np.full(1 << BUCKET_BITS, -1, np.int32)
        slot[best] = np.arange(len(best))
        return slot

    def matrix(self, slot: np.ndarray) -> Sparse:
        hit = slot[self.bucket] >= 0
        return Sparse(np.concatenate([[0], np.cumsum(np.bincount(self.row[hit], minlength=len(self.y)))]), slot[self.bucket[hit]], FEATURES)


def fit(rows: _Rows, folds: np.ndarray) -> tuple[np.ndarray, list[tuple[float, np.ndarray, np.ndarray]], list[float]]:
    """Slots of the features, and a model and a cutoff for each category.

    Each model has the log-odds of the categories before as further inputs. These come out of
    fold: features and weights for a fold's rows are found without them. So do the cutoffs.
    """
    labels = rows.y
    slot = rows.chosen(np.ones(len(labels), bool))
    x = rows.matrix(slot)
    apart = [rows.matrix(rows.chosen(folds != k)) for k in range(FOLDS)]
    models, cutoffs, before = [], [], np.zeros((len(labels), 0))
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        models.append(lasso_logistic(x, y, PENALTY / max(1, len(y)), before, STEPS))
        out = np.zeros(len(y))
        for k in range(FOLDS):
            own = folds == k
            if own.any():
                b, w, c = lasso_logistic(apart[k].rows(~own), y[~own], PENALTY / len(y), before[~own], STEPS)
                out[own] = np.clip(b + apart[k].rows(own).times(w) + before[own] @ c, -10, 10)
        before = np.column_stack([before, out])
        cutoffs.append(_cutoff(sigmoid(out), y))
    return slot, models, cutoffs


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit a chain on at most ``sample_rows`` labelled rows; labels has doc_id and a 0/1 column for each category.

    Rows with a null label or doc_id are not used; without rows all probabilities are near 1/2.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", *categories).na.drop()
    sample = usable.orderBy(F.xxhash64("doc_id"), *["doc_id", *categories]).limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    schema = ", ".join(["doc_id long", *(f"{c} int" for c in categories), "buckets array<int>"])
    got = joined.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories], "text").mapInArrow(_collect, schema).toArrow()
    ids = got["doc_id"].to_numpy().astype(np.int64)
    y = np.stack([got[c].to_numpy() for c in categories], axis=1).astype(int)
    order = np.lexsort((*y.T, ids))
    taken = got["buckets"].combine_chunks().take(pa.array(order)) if len(ids) else pa.array([], pa.list_(pa.int32()))
    ids, y = ids[order], y[order]
    size = np.diff(taken.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    bucket, row = taken.flatten().to_numpy() if len(ids) else np.zeros(0, np.int32), np.repeat(np.arange(len(ids)), size)
    folds = (mix(ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    slot, models, cutoffs = fit(_Rows(row, bucket, y), folds)
    return Chain(list(categories), slot, models, cutoffs)


def probabilities(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and the probability p_... of each category, for every whole text.

    Null and empty texts get the probabilities of a text without words; repeated rows are
    scored each for itself; further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.probabilities(p) for p in slices(batch["text"])]
            p = np.concatenate(parts) if parts else np.zeros((0, len(model.categories)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c) for c in p.T]], ["doc_id", *[f"p_{c}" for c in model.categories]])

    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in chain.categories)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
