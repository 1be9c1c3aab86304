import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score int, block string"


def by_hand(rows, n_pos=5, n_neg=10, low=30, high=90):
    """Sorted rows of the result by all inner products, in Python integers."""
    held = [(r[0], r[1], [math.floor(256 * float(np.float32(x))) for x in r[2]]) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    anchors = {(v, label, tuple(q)) for v, label, q in held if v % 10 == 0}
    out = []
    for v, label, q in anchors:
        scores = sorted((-sum(x * y for x, y in zip(q, r[2])), r[0], r[1]) for r in held)  # noqa: B905  missing components count as 0
        positives = [s for s in scores if s[2] == label and s[1] != v][:n_pos]
        for ps, pid, _ in positives:
            negatives = [s for s in scores if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps][:n_neg]
            out += [(v, pid, k, s[1], -ps, -s[0]) for k, s in enumerate(negatives, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def cloud(n, d=8, seed=1, spread=1.0):
    """Points around a few centres, a third of all of one label and copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, d))
    points = (centres[rng.integers(0, 5, n)] + spread * rng.standard_normal((n, d))).astype(np.float32)
    points[rng.random(n) < 0.33] = points[0]
    return [(i, 0 if i % 3 == 0 else int(rng.integers(0, 6)), p.tolist(), 1, "x") for i, p in enumerate(points)]


@pytest.mark.parametrize("size", [dict(), dict(BLOCK_ANCHORS=7, PASS_BYTES=1000, ROWS=50)])
def test_negatives_as_by_hand(spark, monkeypatch, size):
    for name, value in size.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = cloud(900)
    got = mined(spark, rows)
    assert got == by_hand(rows) and len(got) > 1000
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=80) == by_hand(rows, 2, 3, 50, 80)


def test_odd_rows(spark):
    rows = cloud(200, d=4)
    rows += [rows[10], rows[20], rows[33], (40, 2, [0.5] * 4, 1, "x")]  # repeated rows, and one id with two vectors
    rows += [(None, 1, [1.0] * 4, 1, "x"), (300, None, [1.0] * 4, 1, "x"), (310, 1, None, 1, "x"), (320, 1, [1.0, None, 1.0, 1.0], 1, "x"), (330, 1, [1.0, float("nan"), 1.0, 1.0], 1, "x"), (340, 1, [float("inf")] * 4, 1, "x")]
    rows += [(350, 1, [], 1, "x"), (351, 2, [1.0], 1, "x"), (360, 3, [0.25] * 6, 1, "x"), (-10, 3, [0.5, -0.5, 0.5, 0.5], 1, "x"), (-7, 3, [0.0] * 4, 1, "x")]
    assert mined(spark, rows) == by_hand(rows)


def test_large_components_are_exact(spark):
    rows = [(r[0], r[1], [x * 1e6 for x in r[2]], 1, "x") for r in cloud(60, d=4)]
    got = mined(spark, rows)
    assert got == by_hand(rows) and max(abs(r[4]) for r in got) > hard_negatives._EXACT


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0], 1, "x"), (2, 2, [1.0], 1, "x")]) == []


def test_tree_spares_products(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 16)) * 20
    points = np.floor(256 * (np.repeat(centres, 50, 0) + rng.standard_normal((200, 16)) / 8))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(200)) and all(p < i for i, p in enumerate(parent[1:], 1))
    assert np.allclose(edge[1:], np.linalg.norm(points[order][1:] - points[order][parent[1:]], axis=1))
    weight = sum(edge)
    links = {(i, j): np.linalg.norm(points[i] - points[j]) for i in range(200) for j in range(i)}
    joined, total = list(range(200)), 0.0
    for (i, j), x in sorted(links.items(), key=lambda kv: kv[1]):
        if joined[i] != joined[j]:
            total, gone = total + x, joined[i]
            joined = [joined[j] if g == gone else g for g in joined]
    assert weight == pytest.approx(total)
    block = hard_negatives.Block(0, hard_negatives.Vectors(np.arange(200), np.zeros(200, int), points[order]), parent, edge)
    rows = hard_negatives.Vectors(np.arange(200), np.ones(200, int), points)
    norms, products = np.linalg.norm(points, axis=1), points @ points[order].T
    found = {}
    top = [np.sort(products[:, a])[-20] for a in range(200)]
    worked = hard_negatives.scored(block, rows, norms, lambda a: (top[a], np.inf), lambda a: np.ones(200, bool), lambda a, at, s: found.update({a: (set(at.tolist()), s)}))
    assert all(found[a][0] == set(np.flatnonzero(products[:, a] >= top[a]).tolist()) for a in range(200))
    assert worked < 0.5 * 200 * 200
