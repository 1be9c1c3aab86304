"""Evaluation of calls and refit of the score against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusframe.evaluation import calls as ec
from locusframe.evaluation import metrics, refit

SAMPLES = ("a", "b", "c")
KINDS = ("0|1", "0|0", "1|1", ".|0", "1|0")


@pytest.fixture(scope="module")
def made_up(spark):
    rng = random.Random(12)
    truth = [(f"t{k}", rng.choice(["1", "2"]), rng.randrange(3000), rng.choice(["Alu", "L1", "other"])) for k in range(90)]
    genotypes = [(t[0], s, rng.choice(KINDS)) for t in truth for s in SAMPLES]
    calls = []
    for k in range(250):
        at = rng.randrange(3000)
        calls.append((rng.choice(SAMPLES), k, rng.choice(["1", "2"]), [at, at + rng.randrange(12)], rng.choice([None, "Alu", "L1"]), rng.random() < 0.7, rng.randrange(40), rng.choice(ec.TIERS), rng.choice(["0/1", "1/1", None]), rng.random() < 0.2))
    frames = (
        spark.createDataFrame(calls, "sample string, call long, contig string, points array<long>, family string, passes boolean, qual int, confidence string, genotype string, imprecise boolean"),
        spark.createDataFrame(truth, "id string, contig string, pos long, family string"),
        spark.createDataFrame(genotypes, "id string, sample string, genotype string"),
    )
    return calls, truth, {(i, s): g for i, s, g in genotypes}, frames


def brute_statuses(calls, truth, genotype, tolerance):
    out = {}
    for sample in SAMPLES:
        mine = [c for c in calls if c[0] == sample]
        near = {c[1]: [(min(abs(p - t[2]) for p in c[3]), t) for t in truth if t[1] == c[2] and min(abs(p - t[2]) for p in c[3]) <= tolerance] for c in mine}
        pairs = sorted((d, k, t[0], t) for k, found in near.items() for d, t in found if "1" in genotype[t[0], sample].split("|"))
        matched, used = {}, set()
        for _, k, i, t in pairs:
            if k not in matched and i not in used:
                matched[k] = t
                used.add(i)
        for c in mine:
            k, hits = c[1], [t for _, t in near[c[1]]]
            t = matched.get(k)
            if t:
                status = "tp" if c[4] is None or t[3] == "other" or c[4] == t[3] else "wrong_family"
            elif any("1" in genotype[h[0], sample].split("|") for h in hits):
                status = "duplicate"
            elif any("." in genotype[h[0], sample].split("|") for h in hits):
                status = "unknown"
            elif any("1" in genotype[h[0], s].split("|") for h in hits for s in SAMPLES):
                status = "other_sample"
            else:
                status = "fp"
            out[k] = (status, t[0] if t else None)
    return out


@pytest.mark.parametrize("tolerance", [0, 20, 80])
def test_statuses(made_up, tolerance):
    calls, truth, genotype, frames = made_up
    got = {r.call: (r.status, r.id) for r in ec.statuses(*frames, tolerance).collect()}
    expected = brute_statuses(calls, truth, genotype, tolerance)
    assert got == expected and (tolerance == 0 or len({s for s, _ in expected.values()}) == 6)


def test_levels_tolerances_and_rows(made_up):
    calls, truth, genotype, frames = made_up
    passing = [c for c in calls if c[5]]
    got = {(r.level, r.status): r["count"] for r in ec.by_level(*frames, [10], 20).groupBy("level", "status").count().collect()}
    for level, some in (("any", calls), ("PASS", passing), ("QUAL>=10", [c for c in passing if c[6] >= 10])):
        assert {s: n for (name, s), n in got.items() if name == level} == Counter(s for s, _ in brute_statuses(some, truth, genotype, 20).values())
    table = {(r.tolerance, r.kind): r for r in ec.by_tolerance(*frames, [5, 20]).collect()}
    expected = brute_statuses(passing, truth, genotype, 20)
    carried = [(s, t[0]) for s in SAMPLES for t in truth if "1" in genotype[t[0], s].split("|")]
    by_call = {c[1]: c for c in calls}
    tp = [k for k, (s, _) in expected.items() if s == "tp"]
    false = [k for k, (s, _) in expected.items() if s in ec.FALSE]
    row = table[20, "all"]
    assert (row.calls, row.tp, row.false) == (len(passing), len(tp), len(false)) and row.precision == pytest.approx(len(tp) / (len(tp) + len(false)))
    found = {(by_call[k][0], expected[k][1]) for k in tp}
    assert row.recall == pytest.approx(len(found) / len(carried)) and table[20, "precise"].recall is None
    assert table[20, "imprecise"].calls == sum(c[9] for c in passing)
    judged = ec.statuses(ec.passing(frames[0]), *frames[1:], 20).cache()
    pairs = ec.carried(frames[1], frames[2], frames[0])
    assert sorted((r.sample, r.id) for r in pairs.collect()) == sorted(carried)
    missed = {(r.sample, r.id): r.call_tiers for r in ec.missed_rows(judged, pairs, frames[0], frames[1], 20).collect()}
    assert missed.keys() == set(carried) - found
    for (sample, i), tiers in missed.items():
        t = next(t for t in truth if t[0] == i)
        beside = {c[7] if c[5] else "filtered" for c in calls if c[0] == sample and c[2] == t[1] and min(abs(p - t[2]) for p in c[3]) <= 20}
        assert tiers == (",".join(sorted(beside)) or ".")
    assert ec.false_rows(judged).count() == len(false) and ec.true_rows(judged).count() == len(passing) - len(false)
    told = Counter((ec_true(genotype[expected[k][1], by_call[k][0]]), by_call[k][8]) for k in tp if by_call[k][8])
    assert {(r.true, r.called): r.n for r in ec.genotype_counts(judged).collect()} == told


def ec_true(genotype):
    return "1/1" if genotype.split("|")[:2] == ["1", "1"] else "0/1"


def test_labels(spark):
    rows = spark.createDataFrame([(v,) for v in (3, 4, 16, 17, 33)], "v int").select("v", ec.labels(F.col("v"), [4, 17, 33], " bp").alias("l")).collect()
    assert [r.l for r in rows] == ["< 4 bp", "4-16 bp", "4-16 bp", "17-32 bp", ">= 33 bp"]


def test_bootstrap_draws_with_replacement(spark):
    rng = random.Random(3)
    cells = [(g, loc, rng.randrange(3), 3) for g in range(12) for loc in range(20)]
    df = spark.createDataFrame(cells, "g long, l long, h long, t long")
    row = metrics.bootstrap(df, "g", "l", "h", "t", 300).first()
    share = sum(c[2] for c in cells) / sum(c[3] for c in cells)
    assert row.rounds == 300 and row.low < share < row.high and row.high - row.low < 0.3
    assert metrics.bootstrap(df, "g", "l", "h", "t", 300).first() == row
    same = df.withColumn("h", F.col("t"))
    assert metrics.bootstrap(same, "g", "l", "h", "t", 20).first()[:2] == (1.0, 1.0)
    one = metrics.bootstrap(df, "g", None, "h", "t", 300).first()
    assert one.low < share < one.high and one.high - one.low < row.high - row.low


def test_bootstrap_broadcasts_no_rows_of_all_rounds(spark, monkeypatch):
    cells = [(g, loc, (g * loc) % 3, 3) for g in range(30) for loc in range(7)]
    df = spark.createDataFrame(cells, "g long, l long, h long, t long")
    few = metrics.bootstrap(df, "g", "l", "h", "t", 50).first()
    monkeypatch.setattr(metrics, "BROADCAST_WEIGHTS", 0, raising=False)
    many = metrics.bootstrap(df, "g", "l", "h", "t", 50)
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert many.first() == few


def test_leave_one_out(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("xyz"), rng.randrange(2), rng.randrange(2), rng.randrange(2)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, g string, label int, p int, q int")
    got = {r.k: r.score for r in refit.scored(df, refit.models(df, ["p", "q"], "label", "g"), ["p", "q"], "g").collect()}
    for k, g, _, *values in rows:
        others = [r for r in rows if r[1] != g]
        n = [sum(r[2] == y for r in others) for y in (0, 1)]
        score = math.log10((n[1] + 1) / (n[0] + 1))
        for j, v in enumerate(values):
            share = [(sum(r[3 + j] for r in others if r[2] == y) + 1) / (n[y] + 2) for y in (0, 1)]
            score += math.log10(share[1] / share[0]) if v else math.log10((1 - share[1]) / (1 - share[0]))
        assert got[k] == pytest.approx(score)
    whole = refit.models(df, ["p"], "label").first()
    assert whole.prior == pytest.approx(math.log10((sum(r[2] for r in rows) + 1) / (200 - sum(r[2] for r in rows) + 1)))


def test_labelled_calls_and_features(spark, tmp_path):
    names = "sample contig position family support distinct_starts checked_mates mei_mates identity left_junction right_junction polya_clips polyt_clips tsd_length signal_ratio typed_by breakpoint_clips cipos left_junction_clips right_junction_clips".split()
    rows = [("a", "1", "10", "ALU", "10", "7", "10", "8", "0.98", "9", "10", "1", "0", "5", "0.2", "clips", "0", None, "1", "1"), ("a", "1", "20", None, "0", "0", "0", "0", None, None, "10", "0", "0", None, None, None, "2", "-20,20", "0", "1"), ("b", "1", "10", "SVA", "5", "1", "9", "9", "0.9", "1", "2", "0", "0", None, "0.1", "mates", "0", None, "0", "0")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    (tmp_path / "fp.tsv").write_text("sample\tstatus\tcontig\tposition\na\tfp\t1\t20\n")
    (tmp_path / "tp.tsv").write_text("sample\tstatus\tcontig\tposition\na\ttp\t1\t10\na\ttp\t1\t20\n")
    got = refit.labelled(df, refit.read_table(spark, str(tmp_path / "fp.tsv")), refit.read_table(spark, str(tmp_path / "tp.tsv")))
    assert {(r.sample, r.position): r.label for r in got.collect()} == {("a", "10"): 1, ("a", "20"): 0}
    flags = {(r.sample, r.position): {c[2:] for c in r.__fields__ if c.startswith("f_") and r[c]} for r in refit.features(df).collect()}
    assert flags["a", "10"] == {"both", "tail", "tsd", "identity", "starts", "mei_mates", "ratio", "junction_clips", "many_mei"}
    assert flags["a", "20"] == {"breakpoint_clips", "imprecise"}
    assert flags["b", "10"] == {"both", "mei_mates", "by_mates", "many_mei"}


def test_splits(spark):
    rows = spark.createDataFrame([("s1", "f1", "tuning"), ("s2", "f1", "test"), ("s3", "f2", "related"), ("s4", "f3", "what"), ("s5", "f4", "test")], "sample string, family_id string, set string")
    assert {(r.problem, r.of) for r in refit.split_leaks(rows).collect()} == {("unknown set", "s4"), ("in tuning and test", "f1"), ("related without tuning", "f2")}
    pedigree = spark.createDataFrame([("s1", "f1"), ("s2", "f9"), ("s3", "f2"), ("s4", "f3")], "individual string, family string")
    assert {r.sample for r in refit.pedigree_mismatches(rows, pedigree).collect()} == {"s2", "s5"}


def test_phred_of_scores(spark):
    rows = spark.createDataFrame([(s,) for s in (-3.0, 0.0, 1.0, 20.0)], "s double").select(refit.phred(F.col("s")).alias("q")).collect()
    assert [r.q for r in rows] == [min(round(-10 * math.log10(max(1 / (1 + 10**s), 1e-12))), 60) for s in (-3.0, 0.0, 1.0, 20.0)]


def test_rates_by_sample(made_up):
    calls, truth, genotype, frames = made_up
    judged = ec.statuses(*frames, 20)
    pairs = ec.carried(frames[1], frames[2], frames[0])
    got = {r["sample"]: r for r in ec.summary(judged, pairs, ["sample"]).collect()}
    expected, by_sample = brute_statuses(calls, truth, genotype, 20), defaultdict(Counter)
    for c in calls:
        by_sample[c[0]][expected[c[1]][0]] += 1
    for s, n in by_sample.items():
        assert all(got[s][k] == n[k] for k in ("tp", "fp", "duplicate", "unknown", "other_sample", "wrong_family"))
        assert got[s].truth == sum("1" in genotype[t[0], s].split("|") for t in truth)
