"""Column functions and operators on small literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.evaluation import matching, metrics
from locusframe.functions import scores as sc
from locusframe.functions import sequences as sq
from locusframe.operators import intervals as iv
from locusframe.operators import positions as po
from locusframe.operators import statistics as st
from locusframe.options import Calling, Reading, examples, parse_region
from locusframe.plans import proxies


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("cigar", "expected"), [("5H25S50M20S3H", (25, 20)), ("100S", (0, 0)), ("100M", (0, 0)), ("10S90M", (10, 0)), (None, None)])
def test_soft_clips(spark, cigar, expected):
    got = one(spark, cigar, sq.soft_clips(F.col("x")))
    assert expected is None or (got["left"], got["right"]) == expected


@pytest.mark.parametrize(("cigar", "expected"), [("34M42S", 34), ("5S20M3D10=2X1N4I8H", 36), ("76S", None), ("*", None), ("M5", None)])
def test_reference_span(spark, cigar, expected):
    assert one(spark, cigar, sq.reference_span(F.col("x"))) == expected


@pytest.mark.parametrize(("clip", "at_end", "expected"), [("A" * 12 + "CGTGCC", False, ("A", 12)), ("GCAGCG" + "T" * 11, True, ("T", 11)), ("C" + "A" * 11, False, ("A", 12)), ("ACGT" * 5, False, None), ("", False, None), ("a" * 15, True, ("A", 15))])
def test_poly_tail(spark, clip, at_end, expected):
    got = one(spark, clip, sq.poly_tail(F.col("x"), at_end))
    assert (None if got is None else tuple(got)) == expected


def test_kmers_of_short_strings(spark):
    assert one(spark, "ACG", sq.kmers(F.col("x"), 4)) == []
    assert one(spark, "ACGTA", sq.kmers(F.col("x"), 4)) == ["ACGT", "CGTA"]
    assert one(spark, "AAAAAAAAACG", sq.informative_kmers(F.col("x"), 11)) == []
    assert one(spark, "ACGTN" * 5, sq.canonical_kmers(F.col("x"), 5)) == []
    assert one(spark, "TTTTN", sq.reverse_complement(F.col("x"))) == "NAAAA"


@pytest.mark.parametrize(("p", "expected"), [(0.1, 10), (0.001, 30), (0.0, 99), (1.0, 0)])
def test_phred(spark, p, expected):
    assert spark.range(1).select(sc.phred(F.lit(p)).alias("q")).first().q == expected


@pytest.mark.parametrize(("alt", "ref", "depth", "expected"), [(10, 20, 100, ("0/1", 88)), (0, 30, 100, ("0/1", 0)), (9, 0, 68, ("0/1", None)), (9, 0, 28, ("1/1", None))])
def test_genotype(spark, alt, ref, depth, expected):
    g = spark.range(1).select(sc.genotype(F.lit(alt), F.lit(ref), F.lit(1), F.lit(True), F.lit(depth)).alias("g")).first().g
    assert g.call == expected[0] and expected[1] in (None, g.quality)


def test_gap_clusters(spark):
    rows = [("a", p) for p in (1000, 1100, 1201)] + [("b", 1100), (None, 5), (None, 200)]
    for width in (1, 50, 100_000):
        got = po.gap_clusters(spark.createDataFrame(rows, "c string, p long"), ["c"], "p", 100, [], width).collect()
        assert {(r.c, r.p): r.cluster_start for r in got} == {("a", 1000): 1000, ("a", 1100): 1000, ("a", 1201): 1201, ("b", 1100): 1100, (None, 5): 5, (None, 200): 200}


def test_merge_intervals_touching(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("a", 2, 3), ("b", 5, 9)]
    for width in (1, 7, 1000):
        got = iv.merge_intervals(spark.createDataFrame(rows, "c string, start long, end long"), ["c"], width=width).collect()
        assert {(r.c, r.start, r.end, r.merged) for r in got} == {("a", 0, 20, 3), ("a", 21, 30, 1), ("b", 5, 9, 1)}


def test_equal_rows_in_any_order(spark, monkeypatch):
    """Equal intervals and positions come in another order at the second step than at the first."""
    plain = po.with_previous_max
    for module in (iv, po):
        monkeypatch.setattr(module, "with_previous_max", lambda *a: plain(*a).orderBy(F.rand(7)))
    starts = [40 * i for i in range(30)]
    df = spark.createDataFrame([("a", s, s + 30) for s in starts for _ in range(6)], "c string, start long, end long")
    for width in (7, 100_000):
        merged = iv.merge_intervals(df, ["c"], width=width).collect()
        assert sorted((r.start, r.end, r.merged) for r in merged) == [(s, s + 30, 6) for s in starts]
        clusters = po.gap_clusters(df, ["c"], "start", 30, [], width).collect()
        assert len(clusters) == 180 and all(r.cluster_start == r.start for r in clusters)


def test_overlap_join_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 0, 100), (2, 95, 96), (3, 300, 310)], "i long, a long, b long")
    right = spark.createDataFrame([(1, 5, 99), (2, 96, 305), (3, 310, 311)], "j long, x long, y long")
    left, right = left.withColumn("k", F.lit(1)), right.withColumn("l", F.lit(1))
    got = iv.overlap_join(left, right, [("k", "l")], (F.col("a"), F.col("b")), (F.col("x"), F.col("y"))).select("i", "j").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1), (3, 2)]


def spans(rng, n, keys=3):
    """Intervals of lengths from 0 to 10 ** 9 at places that they share; one key has most of them."""
    out = []
    for i in range(n):
        length = int(10 ** rng.uniform(0, 9)) if rng.random() < 0.95 else 0
        start = rng.choice([0, -5, 4095, 4096, 10**9]) + rng.randrange(-length - 20, length + 20)
        out.append((i, None if i % 61 == 0 else rng.choice([0, 0, 0, *range(keys)]), start, None if i % 67 == 0 else start + length))
    return out


def test_range_joins_of_all_lengths(spark):
    rng = random.Random(12)
    a, b = spans(rng, 500), spans(rng, 400)
    left, right = spark.createDataFrame(a, "i long, k long, a long, b long"), spark.createDataFrame(b, "j long, l long, x long, y long")
    whole = [(p, q) for p in a for q in b if None not in (p[1], p[3], q[1], q[3]) and p[1] == q[1] and p[2] < q[3] and q[2] < p[3]]
    got = iv.overlap_join(left, right, [("k", "l")], (F.col("a"), F.col("b")), (F.col("x"), F.col("y"))).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((p[0], q[0]) for p, q in whole) and len(got) > 10_000
    inside = iv.within_any(left.where("b is null or b > a"), right, [("k", "l")], (F.col("a"), F.col("b")), (F.col("x"), F.col("y"))).collect()
    assert sorted(r.i for r in inside) == sorted({p[0] for p, _ in whole if p[3] > p[2]})
    points = spark.createDataFrame([(i, k, p) for i, k, p, _ in spans(rng, 300)], "i long, k long, p long")
    deep = {r.i: r.depth for r in iv.depth_at(points, right, [("k", "l")], "p", (F.col("x"), F.col("y"))).collect()}
    assert deep == {i: sum(None not in (q[1], q[3], k) and q[1] == k and max(p - 1, 0) < q[3] and q[2] < p + 1 for q in b) for i, k, p in map(tuple, points.collect())}


def test_rows_of_a_range_join_have_few_copies(spark):
    lengths = [7 * 10**k for k in (0, 1, 3, 5, 7, 9)]
    long = spark.createDataFrame([(n,) for n in lengths], "n long").selectExpr("n", "1000 as _left_start", "1000 + n as _left_end")
    cut = long.withColumn("_left_level", iv._level(F.col("_left_start"), F.col("_left_end")))
    every = spark.range(9).selectExpr("cast(id as int) as level")
    copies = {r.n: r["count"] for r in iv._placed(cut, "left", iv._slots(every, "level", True)).groupBy("n").count().collect()}
    assert max(copies.values()) <= 20 and copies[lengths[-1]] <= 4
    few = {r.n: r["count"] for r in iv._placed(cut, "left", iv._slots(every.where("level = 2"), "level", True)).groupBy("n").count().collect()}
    assert max(few.values()) <= 2


def test_within_any_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 95, 105), (1, 95, 105), (1, 0, 5), (1, 250, 260)], "k long, a long, b long")
    regions = spark.createDataFrame([(1, 104, 240)], "c long, s long, e long")
    got = iv.within_any(rows, regions, [("k", "c")], (F.col("a"), F.col("b")), (F.col("s"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(1, 95, 105)] * 2


def test_smallest_mode_and_placement(spark):
    df = spark.createDataFrame([(1, v) for v in (5, 3, 5, 3, 7)], "k long, v long")
    assert tuple(st.smallest_mode(df, ["k"], "v").first()) == (1, 3, 2)
    mates = spark.createDataFrame([(1, 900, 1), (1, 980, 1), (1, 1020, 0)], "k long, p long, side long")
    got = st.placement(mates, ["k"], "p", F.col("side") == 1).first()
    assert (got.breakpoint, got["first"], got["last"]) == (1000, 960, 1040)


def test_running_sums_of_a_hot_key(spark):
    """Each range of a key has its own task; sums and totals as by walking through the rows."""
    rng = random.Random(8)
    rows = [(k, v, rng.randrange(9)) for k in ("hot", None, "b") for v in rng.sample(range(10**6), 900 if k == "hot" else 40)]
    df = spark.createDataFrame(rows, "k string, v long, n long").repartition(4)
    got = po.running_sums(df, ["k"], ["v"], {"before": F.col("n"), "rows": F.lit(1)}, totals=True)
    expected = []
    for k in ("hot", None, "b"):
        total, mine = 0, sorted(r for r in rows if r[0] == k)
        for i, r in enumerate(mine):
            expected.append((*r, total, i, sum(x[2] for x in mine), len(mine)))
            total += r[2]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("Window ")[1:] if "_v_" in x.split("]")[0]]
    assert windows and all("_part" in w.split("\n")[0] for w in windows)
    scores = spark.range(2000).selectExpr("cast(id * 7919 % 2003 as double) as s", "cast(id % 3 = 0 as int) as y")
    pairs = [(r.s, r.y) for r in scores.collect()]
    wins = sum((p > n) + 0.5 * (p == n) for p, y in pairs if y for n, z in pairs if not z)
    ys = sum(y for _, y in pairs)
    assert metrics.auc(scores, "s", "y").first().auc == pytest.approx(wins / (ys * (2000 - ys)))


def test_outlier_threshold(spark):
    df = spark.createDataFrame([(v,) for v in (290, 300, 310, 300, 1000)], "v long")
    assert tuple(st.outlier_threshold(df, [], "v").first()) == (5, 300, 10, 389)


@pytest.mark.parametrize("most", [50_000, 0])
def test_outlier_threshold_joins_no_rows_by_a_hot_key(spark, monkeypatch, most):
    monkeypatch.setattr(st, "BROADCAST_KEYS", most, raising=False)
    joined = []
    plain = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, *a, **b: joined.append(self.columns) or plain(self, *a, **b))
    rows = [("a" if i % 50 else "b", i * 7919 % 1000, f"r{i}") for i in range(3000)]
    got = {r.k: (r.n, r.median, r.mad) for r in st.outlier_threshold(spark.createDataFrame(rows, "k string, v long, read string"), ["k"], "v").collect()}
    for k in "ab":
        values = sorted(v for x, v, _ in rows if x == k)
        middle = values[(len(values) - 1) // 2]
        assert got[k] == (len(values), middle, sorted(abs(v - middle) for v in values)[(len(values) - 1) // 2])
    assert joined and not any("read" in columns for columns in joined)


def test_many_counts_grow_in_tasks_not_in_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(st, "DEALT_ROWS", 100, raising=False)
    df = spark.range(2000).select(F.nullif(F.col("id") % 900, F.lit(5)).alias("k"), (F.col("id") % 2).alias("m"))
    got = st.many_counts(df, ["k", "m"], 2000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]
    assert got.rdd.getNumPartitions() == 21
    assert {(r.k, r.m): r.n for r in got.collect()} == {(r.k, r.m): r["count"] for r in df.groupBy("k", "m").count().collect()}


def test_densest_band(spark):
    df = spark.createDataFrame([(1, d) for d in (50, 3, 0, 1, 2, 70, 60, 2)], "k long, d long")
    assert tuple(po.densest_band(df, ["k"], "d").first()) == (1, 5, 0, 3)


def test_even_sample(spark):
    ranks = sorted(r.id for r in po.even_sample(spark.range(100).withColumn("k", F.lit(1)), ["k"], ["id"]).collect())
    assert ranks[:4] == [0, 3, 5, 8] and ranks[-1] == 98 and len(ranks) == 40


def test_loci(spark):
    df = spark.createDataFrame([(1, p) for p in (1000, 1050, 1150, 5000)], "k long, p long")
    assert {(r["first"], r["last"], r.points) for r in iv.loci(df, ["k"], "p").collect()} == {(1000, 1150, 3), (5000, 5000, 1)}


def test_lower_bound():
    assert metrics.lower_bound(59, 59, 0.95) > 0.95 > metrics.lower_bound(58, 58, 0.95)
    assert metrics.lower_bound(5, 10, 0.95) == pytest.approx(0.2224, abs=1e-4) and metrics.lower_bound(0, 10) == 0.0


def by_order(pairs):
    """Pairs (distance, left, right) in order, each if both sides are free."""
    lefts, rights, taken = set(), set(), []
    for d, i, j in sorted(pairs):
        if i not in lefts and j not in rights:
            lefts.add(i)
            rights.add(j)
            taken.append((d, i, j))
    return sorted(taken)


def test_greedy_match(spark):
    pairs = [("s", c, t, abs(c - t)) for c in (1018, 1012) for t in (1000, 1030)]
    got = matching.greedy_match(spark.createDataFrame(pairs, "k string, c long, t long, d long"), ["k"], "c", "t", "d").collect()
    assert {(r.c, r.t) for r in got} == {(1018, 1030), (1012, 1000)}
    rng = random.Random(5)
    listed = [(k, c, t, rng.randrange(6)) for k in (None, 1, 2) for c in range(9) for t in range(9) if rng.random() < 0.6]
    got = matching.greedy_match(spark.createDataFrame([*listed, listed[0], (1, 3, None, 0)], "k int, c long, t long, d long"), ["k"], "c", "t", "d").collect()
    for k in (None, 1, 2):
        assert sorted((r.d, r.c, r.t) for r in got if r.k == k) == by_order([(d, c, t) for q, c, t, d in listed if q == k])


def test_matches_of_points_without_their_pairs(spark):
    rng = random.Random(4)
    points, expected = [], {}
    for user in range(60):
        span = (5, 40, 300)[user % 3]
        mine = [(rng.randrange(span), rng.random() < 0.5, i) for i in rng.sample(range(1000), rng.randrange(40))]
        points += [(user, *p) for p in mine]
        expected[user] = by_order([(abs(p - q), i, j) for p, a, i in mine if a for q, b, j in mine if not b and abs(p - q) <= 9])
    df = spark.createDataFrame([*points, (None, 1, True, 5), (3, None, True, 2000)], "user int, pos long, is_left boolean, id long")
    got = matching.match_by_position(df, ["user"], "pos", "is_left", "id", 9, "l", "r")
    assert got.columns == ["user", "l", "r", "distance"]
    rows = got.collect()
    for user, pairs in expected.items():
        assert sorted((r.distance, r.l, r.r) for r in rows if r.user == user) == pairs


def test_one_user_with_all_points(spark):
    """25 million pairs of one user, where both sides meet; and sparse points in one run without a gap."""
    dense = spark.range(10_000).selectExpr("1 as user", "id % 100 as pos", "id % 200 < 100 as is_left", "id")
    got = matching.match_by_position(dense, ["user"], "pos", "is_left", "id", 7200, "l", "r")
    assert got.agg(F.count("*"), F.sum("distance")).collect()[0][:] == (5000, 0)
    rng = random.Random(6)
    mine = [(i * 5 + rng.randrange(5), rng.random() < 0.5, i) for i in range(3000)]
    df = spark.createDataFrame([(1, *p) for p in mine], "user int, pos long, is_left boolean, id long").repartition(3)
    got = matching.match_by_position(df, ["user"], "pos", "is_left", "id", 40, "l", "r")
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    assert sorted((r.distance, r.l, r.r) for r in got.collect()) == by_order([(abs(p - q), i, j) for p, a, i in mine if a for q, b, j in mine[max(0, i - 12) : i + 13] if not b and abs(p - q) <= 40])


def test_best_quality_and_examples():
    assert sc.most_quality() == 26
    assert examples(["a", "b"]) == "a, b" and examples(list("abcdefg")) == "a, b, c, d, e, ..."


def test_regions_and_options():
    assert parse_region("chr1") == ("chr1", None, None) and parse_region("chr1:1,001-2,000") == ("chr1", 1000, 2000)
    assert parse_region("HLA:01") == ("HLA:01", None, None)
    with pytest.raises(ValueError, match="begins"):
        parse_region("chr1:5-2")
    with pytest.raises(ValueError, match="polya"):
        Reading(polya_min_frac=0.0)
    assert Calling().least_quality == 10 and Calling(profile="discovery").least_quality == 0 and Calling(min_qual=3).least_quality == 3
