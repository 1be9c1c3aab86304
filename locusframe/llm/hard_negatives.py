"""Hard negatives of anchors among all rows, by bounds along spanning trees of the anchors.

Anchors come in blocks of neighbours, each with a spanning tree of least distances. A row's score with an
anchor differs from its score with the parent in the tree by at most the edge's length times the row's
norm. So a row's exact score at one anchor, or bounds of it, bound its scores at the children; only where the
bounds overlap the window in which a score would count is the inner product worked out.

All rows are held against all blocks: a pass takes blocks of a bounded number of bytes to every task, which
reads its rows once and keeps, for each anchor, the few best it has seen. Those few are then merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import bounded_batches, new_path, written

#: Anchors and bytes of a block, bytes of the blocks of one pass, rows scored at once.
BLOCK_ANCHORS, BLOCK_BYTES, PASS_BYTES, ROWS = 1024, 4 << 20, 8 << 20, 4096
#: Sums of products below this are exact as doubles, with room for the bounds' rounding.
_EXACT = 1 << 50
_SKETCH_BITS = 48


class Vectors(NamedTuple):
    """Rows that take part: ids, labels, integer components (as doubles, or Python integers if large)."""

    ids: np.ndarray
    labels: np.ndarray
    parts: np.ndarray


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector lengths, all components one after the other (null as NaN), and which vectors are finite throughout."""
    lists = batch["vector"]
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(flat)], minlength=len(lengths)) == 0
    return lengths, flat, whole


def _vectors(batch: pa.RecordBatch, scale: float) -> Vectors:
    """The rows of a batch without a missing component; shorter vectors are filled with zeros."""
    lengths, flat, whole = _flat(batch)
    row = np.repeat(np.arange(len(lengths)), lengths)
    width = int(lengths.max()) if len(lengths) else 0
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = np.zeros((len(lengths), width))
    parts[row, column] = np.floor(np.where(np.isfinite(flat), flat, 0.0) * scale)
    return Vectors(batch["vec_id"].to_numpy(zero_copy_only=False)[whole], batch["label"].to_numpy(zero_copy_only=False)[whole], parts[whole])


def _gathered(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Vectors]:
    """Vectors of about ROWS rows, and no more than a block's bytes and a batch."""
    held: list[Vectors] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_vectors(batch, scale))
        if sum(len(v.ids) for v in held) >= ROWS or sum(v.parts.nbytes for v in held) >= BLOCK_BYTES:
            yield _stacked(held)
            held = []
    if held:
        yield _stacked(held)


def _stacked(held: list[Vectors]) -> Vectors:
    width = max(v.parts.shape[1] for v in held)
    parts = [np.pad(v.parts, ((0, 0), (0, width - v.parts.shape[1]))) for v in held]
    return Vectors(np.concatenate([v.ids for v in held]), np.concatenate([v.labels for v in held]), np.concatenate(parts))


class Block(NamedTuple):
    """Anchors in an order in which parents come before children, with parents (of the first: itself) and edges."""

    number: int
    anchors: Vectors
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning tree of least distances: the order of the points, and each one's parent (as a place in that order) and distance to it."""
    n = len(parts)
    norm = np.einsum("ij,ij->i", parts, parts)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, at, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    for place in range(n):
        order[place], left[now] = now, False
        parent[place], edge[place] = at[now], near[now] if place else 0.0
        square = norm + norm[now] - 2 * (parts @ parts[now])
        closer = left & (square < near)
        near[closer], at[closer] = square[closer], place
        now = int(np.argmin(np.where(left, near, np.inf)))
    return order, parent, np.sqrt(np.maximum(edge, 0.0))


def _packed(number: int, anchors: Vectors) -> tuple:
    order, parent, edge = spanning_tree(anchors.parts)
    return number, len(order), anchors.ids[order].astype("<i8").tobytes(), anchors.labels[order].astype("<i8").tobytes(), anchors.parts[order].astype("<f8").tobytes(), parent.astype("<i8").tobytes(), edge.astype("<f8").tobytes()


def _unpacked(row) -> Block:
    ids, labels, parent = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "parent"))
    anchors = Vectors(ids, labels, np.frombuffer(row["parts"], "<f8").reshape(len(ids), -1))
    return Block(row["block"], anchors, parent, np.frombuffer(row["edge"], "<f8"))


_BLOCKS = "block long, n long, ids binary, labels binary, parts binary, parent binary, edge binary"


def _sketches(scale: float) -> Callable:
    """Adds to each anchor the signs of its products with fixed directions, as one number: neighbours share leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_flat(batch)[2]))
            parts = _vectors(kept, scale).parts
            directions = np.random.default_rng(1).standard_normal((parts.shape[1], _SKETCH_BITS))
            signs = (parts @ directions > 0) @ (1 << np.arange(_SKETCH_BITS)[::-1])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(signs.astype(np.int64))], [*kept.schema.names, "sketch"])

    return run


def _blocks(scale: float) -> Callable:
    """Cuts sorted anchors into blocks; a block's number tells its partition and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def out(held: list[Vectors]) -> pa.RecordBatch:
            columns = zip(*[_packed(number, _stacked(held))], strict=True)
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

        held: list[Vectors] = []
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # few at a time, so that a block's bounds hold
                held.append(_vectors(batch.slice(first, 64), scale))
                if sum(len(v.ids) for v in held) >= BLOCK_ANCHORS or sum(v.parts.nbytes for v in held) >= BLOCK_BYTES:
                    yield out(held)
                    held, number = [], number + 1
        if held:
            yield out(held)

    return run


def exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products with integer components of any size; missing ones count as 0."""
    width = min(rows.shape[1], len(anchor))
    rows, anchor = rows[:, :width], anchor[:width]
    if not width or np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * width < _EXACT:
        return rows @ anchor
    whole = [[int(x) for x in r] for r in rows]
    found = [sum(x * int(y) for x, y in zip(r, anchor, strict=True)) for r in whole]
    if found and max(map(abs, found)) >= 1 << 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return np.array(found, object)


class Best:
    """For each of some places the best (score, id) pairs seen: higher scores, then smaller ids."""

    def __init__(self, places: int, most: int):
        self.most, self.kept = most, [(np.zeros(0), np.zeros(0, np.int64))] * places

    def least(self, place: int) -> float:
        """The score that a further pair must reach; minus infinity while fewer than ``most`` are kept."""
        scores = self.kept[place][0]
        return scores[-1] if len(scores) == self.most else -np.inf

    def add(self, place: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.kept[place][0], scores]), np.concatenate([self.kept[place][1], ids])
        numbers = scores.astype(np.int64)  # both kinds of scores fit
        first = np.lexsort((ids, -numbers))[: self.most]
        self.kept[place] = scores[first], ids[first]


def scored(block: Block, rows: Vectors, norms: np.ndarray, window: Callable[[int], tuple[float, float]], wanted: Callable[[int], np.ndarray], found: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Walk a block's tree for some rows: exact scores only where the bounds overlap an anchor's window.

    window(a): least and greatest score that would count. wanted(a): which rows may count at all.
    found(a, at, scores) gets the rows worked out. Returns how many inner products that took.
    """
    low, high = np.zeros((2, len(block.parent), len(norms)))
    worked = 0
    large = not len(norms) or np.abs(rows.parts).max(initial=0) * np.abs(block.anchors.parts).max(initial=0) * rows.parts.shape[1] >= _EXACT
    for a, (parent, edge) in enumerate(zip(block.parent.tolist(), block.edge.tolist(), strict=True)):
        if a and not large:
            reach = norms * (edge * (1 + 1e-9)) + 1  # scores are integers; 1 covers the rounding
            np.subtract(low[parent], reach, out=low[a])
            np.add(high[parent], reach, out=high[a])
        else:
            low[a], high[a] = -np.inf, np.inf
        least, most = window(a)
        if least > most and a:
            continue
        near = wanted(a) & (high[a] >= least) & (low[a] <= most)
        n = int(np.count_nonzero(near))
        if n > len(near) // 4 or not a and not large:  # the whole batch at once costs less than picking rows
            scores = exact(rows.parts, block.anchors.parts[a])
            worked += len(scores)
            if not large:
                low[a] = high[a] = scores
            at = np.flatnonzero(near)
            scores = scores[at]
        elif n:
            at = np.flatnonzero(near)
            scores = exact(rows.parts[at], block.anchors.parts[a])
            worked += n
            if not large:
                low[a][at] = high[a][at] = scores
        else:
            continue
        counts = (scores >= least) & (scores <= most)
        if counts.any():
            found(a, at[counts], scores[counts])
    return worked


_PARTIAL = "block long, anchor long, nth int, anchor_id long, vec_id long, score long"


def _rows(block: Block, best: Best, per_anchor: int) -> pa.RecordBatch:
    places = np.repeat(np.arange(len(best.kept)), [len(s) for s, _ in best.kept])
    scores = [int(x) for s, _ in best.kept for x in s]
    ids = np.concatenate([i for _, i in best.kept]) if best.kept else np.zeros(0, np.int64)
    at = places // per_anchor
    columns = [np.full(len(places), block.number), at, (places % per_anchor).astype(np.int32), block.anchors.ids[at], ids, scores]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], [c.split()[0] for c in _PARTIAL.split(", ")])


def _positives(blocks, most: int, scale: float) -> Callable:
    """The best rows of an anchor's label in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [_unpacked(r) for r in blocks.value]
        best = [Best(len(b.parent), most) for b in trees]
        for rows in _gathered(batches, scale):
            norms = np.sqrt(np.einsum("ij,ij->i", rows.parts, rows.parts))
            same = {label: rows.labels == label for label in np.unique(rows.labels).tolist()}
            none = np.zeros(len(norms), bool)
            for b, kept in zip(trees, best, strict=True):
                ids, labels = b.anchors.ids, b.anchors.labels.tolist()
                scored(b, rows, norms, lambda a, kept=kept: (kept.least(a), np.inf), lambda a, ids=ids, labels=labels: same.get(labels[a], none) & (rows.ids != ids[a]), lambda a, at, scores, kept=kept: kept.add(a, scores, rows.ids[at]))
        for b, kept in zip(trees, best, strict=True):
            yield _rows(b, kept, 1)

    return run


def _negatives(blocks, windows, n_positives: int, most: int, scale: float) -> Callable:
    """For each of an anchor's positives the best rows of other labels in its window in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [_unpacked(r) for r in blocks.value]
        best = [Best(len(b.parent) * n_positives, most) for b in trees]
        for rows in _gathered(batches, scale):
            norms = np.sqrt(np.einsum("ij,ij->i", rows.parts, rows.parts))
            other = {label: rows.labels != label for label in np.unique(rows.labels).tolist()}
            every = np.ones(len(norms), bool)
            for b, kept in zip(trees, best, strict=True):
                low, high = windows.value[b.number]
                labels = b.anchors.labels.tolist()

                def least(a: int, low=low, kept=kept) -> list[float]:
                    return [max(low[a][k], kept.least(a * n_positives + k)) for k in range(n_positives)]

                def window(a: int, high=high, least=least) -> tuple[float, float]:
                    open_ones = [(x, y) for x, y in zip(least(a), high[a], strict=True) if x <= y]
                    return (min(x for x, _ in open_ones), max(y for _, y in open_ones)) if open_ones else (np.inf, -np.inf)

                def found(a: int, at: np.ndarray, scores: np.ndarray, high=high, least=least, kept=kept) -> None:
                    for k, x in enumerate(least(a)):
                        inside = (scores >= x) & (scores <= high[a][k])
                        if inside.any():
                            kept.add(a * n_positives + k, scores[inside], rows.ids[at[inside]])

                scored(b, rows, norms, window, lambda a, labels=labels: other.get(labels[a], every), found)
        for b, kept in zip(trees, best, strict=True):
            yield _rows(b, kept, n_positives)

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives the hardest negatives in a window of scores.

    Components become floor(scale * component); a score is the integer inner product with the
    anchor. Higher scores come first, equal ones by smaller vec_id. An anchor's positives are its first
    ``positives`` other rows (by vec_id) of its label; a positive's negatives are the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * score <= high * positive_score. Returns anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score; the result is exact.

    Rows without a vec_id, a label or a vector, or with a null or non-finite component, take no part. Missing
    components of shorter vectors count as 0, empty vectors too. A repeated row is a row of its own: it may be listed
    again as positive or negative; an anchor's own vec_id is never its positive. Anchors alike in vec_id, label and vector count once.
    A score beyond 64 bits is an error. Anchors without a positive or negative have no rows; an empty table gives
    none; further columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("_anchor"))
    anchors = rows.where("_anchor").drop("_anchor").dropDuplicates()
    kind = rows.schema["vector"].dataType.simpleString()
    placed = anchors.mapInArrow(_sketches(scale), f"vec_id long, label long, vector {kind}, sketch long")
    n_anchors = rows.where("_anchor").count()
    near = placed.repartitionByRange(max(1, n_anchors // (8 * BLOCK_ANCHORS)), "sketch", "vec_id").sortWithinPartitions("sketch", "vec_id")
    blocks = written(near.select("vec_id", "label", "vector").mapInArrow(_blocks(scale), _BLOCKS), "anchor-blocks")
    every = rows.select("vec_id", "label", "vector")

    passes: list[list[int]] = []
    room = 0
    for r in blocks.select("block", F.octet_length("parts").alias("bytes")).orderBy("block").toLocalIterator():
        if not passes or room < r["bytes"]:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append(r["block"])
        room -= r["bytes"]

    first, then = new_path(spark, "positives"), new_path(spark, "negatives")
    for numbers in passes or [[]]:
        shared = spark.sparkContext.broadcast(blocks.where(F.col("block").between(numbers[0], numbers[-1])).collect() if numbers else [])
        every.mapInArrow(_positives(shared, positives, scale), _PARTIAL).write.mode("append").parquet(first)
        shared.unpersist()
    best = Window.partitionBy("block", "anchor").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(_PARTIAL).parquet(first).withColumn("nth", F.row_number().over(best) - 1).where(F.col("nth") < positives)
    chosen = written(ranked, "positives-best")

    for numbers in passes or [[]]:
        between = F.col("block").between(numbers[0], numbers[-1]) if numbers else F.lit(False)
        held = blocks.where(between).collect()
        windows = {r["block"]: tuple([[bound] * positives for _ in range(r["n"])] for bound in (np.inf, -np.inf)) for r in held}
        for r in chosen.where(between).select("block", "anchor", "nth", "score").toLocalIterator():
            least, most = windows[r["block"]]
            least[r["anchor"]][r["nth"]], most[r["anchor"]][r["nth"]] = -(-low * r["score"] // 100), high * r["score"] // 100
        shared, bounds = spark.sparkContext.broadcast(held), spark.sparkContext.broadcast(windows)
        every.mapInArrow(_negatives(shared, bounds, positives, negatives, scale), _PARTIAL).write.mode("append").parquet(then)
        shared.unpersist()
        bounds.unpersist()
    best = Window.partitionBy("block", "anchor", "nth").orderBy(F.desc("score"), "vec_id")
    merged = spark.read.schema(_PARTIAL).parquet(then).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    pairs = merged.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(chosen.select("block", "anchor", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "anchor", "nth"])
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
