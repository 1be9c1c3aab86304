"""Quality classifier: an ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on a bounded labelled sample; the paths to their nodes are the
rules. A logistic model with an L1 penalty keeps few of them, and those are compiled into one
Spark column expression over the statistics, which are Spark expressions themselves.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import lasso_logistic

#: The labelled rows a model is fitted on at most: those with the least hash of doc_id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, CELLS, MIN_LEAF = 30, 3, 48, 20
PENALTY = 2e-4

_WORDS = r"filter(split(body, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÙÚÛÜ"
#: Name and SQL of the statistics, over body, words and n_words.
STATISTICS: dict[str, str] = {
    "log_words": "ln(1 + n_words)",
    "distinct_words": "size(array_distinct(words)) / greatest(n_words, 1)",
    "word_chars": "length(body) / greatest(n_words, 1)",
    "upper": f"(length(body) - length(translate(body, '{_UPPER}', ''))) / greatest(length(body), 1)",
    "symbols": "(length(body) - length(translate(body, '#*$%&<>@^~', ''))) / greatest(n_words, 1)",
    "bars": "(length(body) - length(replace(body, '|', ''))) / greatest(n_words, 1)",
    "exclamations": "(length(body) - length(replace(body, '!', ''))) / greatest(n_words, 1)",
    "digits": "(length(body) - length(translate(body, '0123456789', ''))) / greatest(length(body), 1)",
    "stops": "(length(body) - length(translate(body, '.,;:?', ''))) / greatest(n_words, 1)",
    "line_words": "n_words / (1 + length(body) - length(replace(body, '\\n', '')))",
}


class Rule(NamedTuple):
    """A conjunction of (statistic, "<=" or ">", value), and its weight."""

    parts: tuple[tuple[str, str, float], ...]
    weight: float

    def column(self) -> Column:
        tests = [F.col(f"s_{s}") <= v if op == "<=" else F.col(f"s_{s}") > v for s, op, v in self.parts]
        return reduce(lambda a, b: a & b, tests)


class RuleModel(NamedTuple):
    intercept: float
    rules: list[Rule]

    def score(self) -> Column:
        """Probability of label 1, over the s_... columns of with_statistics."""
        total = reduce(lambda a, r: a + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)), self.rules, F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and an s_... column for each statistic of the whole text (null: empty)."""
    split = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("body"))
    split = split.withColumn("words", F.expr(_WORDS)).withColumn("n_words", F.size("words"))
    return split.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], *[F.expr(sql).cast("double").alias(f"s_{name}") for name, sql in STATISTICS.items()])


def held_out() -> Column:
    """Documents whose labels are for testing: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _grow(cells: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray, depth: int, path: tuple, found: list) -> np.ndarray:
    """Split rows where that gains most; adds the path of each node to found. Returns the step of each row of all."""
    step = np.zeros(len(gradient))
    step[rows] = gradient[rows].sum() / (curvature[rows].sum() + 1.0)
    if path:
        found.append(path)
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return step
    best = (1e-6, None, None)
    g_all, h_all = gradient[rows].sum(), curvature[rows].sum()
    for f in range(cells.shape[1]):
        if not len(cuts[f]):
            continue
        own = cells[rows, f]
        g, h, n = (np.cumsum(np.bincount(own, w, len(cuts[f]) + 1))[:-1] for w in (gradient[rows], curvature[rows], None))
        gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
        gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] is None:
        return step
    _, f, k = best
    left = cells[rows, f] <= k
    for side, op in ((left, "<="), (~left, ">")):
        part = _grow(cells, cuts, gradient, curvature, rows[side], depth - 1, (*path, (f, op, float(cuts[f][k]))), found)
        step[rows[side]] = part[rows[side]]
    return step


def _merged(path: tuple) -> tuple:
    """A path with at most one upper and one lower bound for a statistic."""
    tight: dict[tuple[int, str], float] = {}
    for f, op, v in path:
        tight[f, op] = (min if op == "<=" else max)(v, tight.get((f, op), v))
    return tuple((f, op, v) for (f, op), v in sorted(tight.items()))


def fit(values: np.ndarray, labels: np.ndarray, names: list[str]) -> RuleModel:
    """Grow trees, turn their paths into rules and weigh these. Without rows the score is 0.5."""
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, CELLS + 1)[1:-1])) if len(values) else np.zeros(0) for f in range(values.shape[1])]
    cuts = [(c + np.array([values[:, f][values[:, f] > x].min(initial=x) for x in c])) / 2 if len(c) else c for f, c in enumerate(cuts)]
    cells = np.stack([np.searchsorted(c, values[:, f], "left") for f, c in enumerate(cuts)], axis=1) if len(values) else np.zeros((0, len(names)), int)
    raw, paths = np.zeros(len(labels)), []
    if len(labels) and labels.min() != labels.max():
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            raw += 0.3 * np.clip(_grow(cells, cuts, labels - p, p * (1 - p), np.arange(len(labels)), DEPTH, (), paths), -4, 4)
    unique: dict[bytes, tuple[tuple, np.ndarray]] = {}
    for path in dict.fromkeys(map(_merged, paths)):
        covers = np.ones(len(labels), bool)
        for f, op, v in path:
            covers &= values[:, f] <= v if op == "<=" else values[:, f] > v
        unique.setdefault(np.packbits(covers).tobytes(), (path, covers))
    x = np.stack([c for _, c in unique.values()], axis=1).astype(np.float32) if unique else np.zeros((len(labels), 0), np.float32)
    intercept, weights, _ = lasso_logistic(x, labels.astype(float), PENALTY, steps=400)
    kept = [Rule(tuple((names[f], op, v) for f, op, v in path), float(w)) for (path, _), w in zip(unique.values(), weights, strict=True) if abs(w) > 1e-4]
    return RuleModel(intercept, kept)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on the labelled rows that aren't held out (at most ``sample_rows`` of them)."""
    usable = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = with_statistics(joined, ["quality"]).toArrow()
    values = np.stack([got[f"s_{s}"].to_numpy() for s in STATISTICS], axis=1)
    order = np.lexsort((got["quality"].to_numpy(), *values.T))
    return fit(values[order], got["quality"].to_numpy()[order].astype(int), list(STATISTICS))


def scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out and score of every document.

    Null and empty texts are scored by their statistics (all 0) like others; repeated rows are
    scored each for itself; further columns are ignored. A null doc_id isn't held out.
    """
    return with_statistics(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
