import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import mixing, queries, runtime

STEEP = [[(0, 7.5), (1, 2.5)], [(0, 2), (1, 2)], [(0, 0.25), (0.5, 0.75), (1, 2.25)]]


def by_hand(rows, schedule, share, cap):
    """{(doc_id, text, source): (taken, first position)...} as lists, by a walk over each source's words."""
    sizes, docs = Counter(), defaultdict(list)
    for doc, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        place = int(hashlib.md5(f"{'' if doc is None else doc} {text or ''}".encode()).hexdigest()[:15], 16)
        sizes[source] += n
        docs[source].append((place, -1 if doc is None else doc, n))
    grid = np.linspace(0, 1, 200_001)
    demand = {}
    for s in sizes:
        knots = sorted(schedule.get(s, []))
        w = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots]) if knots else np.zeros_like(grid)
        demand[s] = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
    free, target, left = {s for s in sizes if demand[s][-1] > 0}, dict.fromkeys(sizes, 0.0), share * sum(sizes.values())
    while free:
        unit = left / sum(demand[s][-1] for s in free)
        full = {s for s in free if demand[s][-1] * unit > cap * sizes[s]}
        target |= {s: demand[s][-1] * unit for s in free} | {s: cap * sizes[s] for s in full}
        if not full:
            break
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    out = defaultdict(list)
    for s, mine in docs.items():
        start, goal = 0, int(target[s] + 0.5)
        for _, doc, n in sorted(mine):
            parts = [min(max(goal - k * sizes[s] - start, 0), n) for k in range(4)]
            first = np.interp((start + parts[0] / 2) / goal * demand[s][-1], demand[s], grid) if parts[0] else None
            out[s, doc].append((n, sum(parts), first))
            start += n
    return out, target


def held(spark, rows, schedule, share=1.5, cap=2.0):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    knots = spark.createDataFrame([(s, float(t), float(w)) for s, ks in schedule.items() for t, w in ks], "source string, time double, weight double")
    return mixing.curriculum(df, knots, share, cap)


def same(got, rows, schedule, share, cap):
    expected, target = by_hand([r[:3] for r in rows], schedule, share, cap)
    found = defaultdict(list)
    for r in got:
        found[r.source, -1 if r.doc_id is None else r.doc_id].append((r.size, r.taken, r.copies[0].position if r.copies else None))
        assert r.target == pytest.approx(target[r.source])
    assert found.keys() == expected.keys()
    for k, mine in found.items():
        for a, b in zip(sorted(mine, key=str), sorted(expected[k], key=str), strict=True):
            assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-4)


@pytest.mark.parametrize("pieces", [20_000, 3])
def test_mix_as_by_hand(spark, monkeypatch, pieces):
    monkeypatch.setattr(mixing, "PIECE_ROWS", pieces)
    rng = np.random.default_rng(3)
    source = lambda i: "hot" if i % 3 == 0 else None if i % 7 == 0 else ("", "a", "b", "unnamed")[i % 4]
    rows = [(i, None if i % 50 == 0 else " w" * int(rng.integers(0, 40)), source(i), 1) for i in range(400)]
    rows += [rows[3]] * 5 + [(None, "no id here", "a", 1), (3, "another text of one id", "hot", 1)]
    schedule = {"hot": STEEP[2], None: STEEP[1], "": [(0.3, 0), (0.6, 4)], "a": STEEP[0], "b": [(0, 0), (1, 0)], "absent": [(0, 9)]}
    got = held(spark, rows, schedule).collect()
    same(got, rows, schedule, 1.5, 2.0)
    assert {r.source for r in got if not r.taken and r.size} >= {"b", "unnamed"}
    small = held(spark, rows, schedule, 0.3, 3.0).collect()
    same(small, rows, schedule, 0.3, 3.0)


def test_many_sources_are_joined_with_salt(spark, monkeypatch):
    rows = [(i, "x y z " * (i % 5), "hot" if i % 2 else f"s{i}", 1) for i in range(300)]
    schedule = {r[2]: STEEP[i % 3] for i, r in enumerate(rows)}
    whole = Counter(str(r) for r in held(spark, rows, schedule).collect())
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert Counter(str(r) for r in held(spark, rows, schedule).collect()) == whole


def test_training_order_follows_the_schedule(spark):
    rows = [(i, "w " * 10, ("a", "b")[i % 2], 1) for i in range(4000)]
    order = mixing.training_order(held(spark, rows, {"a": [(0, 3), (1, 1)], "b": [(0, 1), (1, 3)]}, 1.0)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.words for r in order) == 40_000
    tenth = len(order) // 10
    shares = [sum(r.source == "a" for r in part) / tenth for part in (order[:tenth], order[-tenth:])]
    assert abs(shares[0] - 0.725) < 0.02 and abs(shares[1] - 0.275) < 0.02  # mean weights of the first and last tenth


def test_odd_rows_and_no_rows(spark, odd, odd_rows, no_rows):
    rows = [(r[0], r[1], r[3], 1) for r in odd_rows]
    schedules = mixing.cycled_schedules(odd, STEEP)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    assert {(r.source, r.time, r.weight) for r in schedules.collect()} == {(s, t, w) for i, s in enumerate(names) for t, w in STEEP[i % 3]}
    got = mixing.curriculum(odd, schedules, 1.5, 2.0).collect()
    same(got, rows, {s: STEEP[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    assert len(got) == len(odd_rows)
    assert mixing.curriculum(no_rows, schedules).count() == 0
    assert mixing.curriculum(odd, schedules.limit(0)).agg(F.sum("taken")).collect()[0][0] == 0


def test_mixing_is_native_and_reruns_agree(spark):
    df = queries.queries()["op11_mixing"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop"))
    again = queries.queries()["op11_mixing"](spark, "/root/testdata/sf0.001")
    assert df.collect() == again.collect()
