"""Local alignment against a plain dynamic program, and typing of simulated sequences."""

import random

from pyspark.sql import functions as F

from locusframe.functions import alignment
from locusframe.plans import typing

from .simulate import dna, flip


def plain_score(a, b):
    none = -(10**9)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[none] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[none] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i][j - 1] - 7, e[i][j - 1] - 2)
            f[i][j] = max(h[i - 1][j] - 7, f[i - 1][j] - 2)
            pair = 2 if a[i - 1] == b[j - 1] != "N" else -3
            h[i][j] = max(0, h[i - 1][j - 1] + pair, e[i][j], f[i][j])
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(60):
        a = dna(rng, rng.randrange(1, 40))
        b = list(a + dna(rng, 5)) if rng.random() < 0.7 else list(dna(rng, 30))
        for _ in range(rng.randrange(5)):
            b[rng.randrange(len(b))] = rng.choice(["", "N", "AC", "T"])
        b = "".join(b)
        score, matches, columns, qs, qe, ts, te = alignment.align(a, b)
        assert score == plain_score(a, b)
        assert 0 <= matches <= min(qe - qs, te - ts) and columns >= max(qe - qs, te - ts)
    assert alignment.align("", "ACGT") == alignment.align("NNN", "NNN") == (0,) * 7


def test_votes_join_no_hits_by_a_hot_key(spark, monkeypatch):
    kind, joined = type(spark.range(1)), []
    plain = kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a, **b: joined.append(self.columns) or plain(self, *a, **b))
    rows = [("a", i // 2, i % 4 == 0, "AB"[i % 3 == 0], i % 5, f"n{i % 5}", i % 2 == 0, i % 7, 0.5, i % 11, 20 + i % 11) for i in range(400)]
    typed = spark.createDataFrame(rows, "k string, voter long, short boolean, family string, cid int, name string, reverse boolean, score long, identity double, element_start int, element_end int")
    got = typing.clip_vote(typed, ["k"], "voter").collect()
    best = {}
    for _, voter, *_, in rows:
        for f in "AB":
            scores = [r[7] for r in rows if r[1] == voter and r[3] == f]
            if scores:
                best[f, voter] = max(scores)
    family = max("AB", key=lambda f: sum(s for (x, _), s in best.items() if x == f))
    by_cid = {c: sum(r[7] for r in rows if r[3] == family and r[4] == c) for c in range(5)}
    chosen = max(by_cid, key=lambda c: (by_cid[c], -c))
    assert [(r.k, r.family, r.subfamily, r.typed_clips) for r in got] == [("a", family, f"n{chosen}", sum(f == family for f, _ in best))]
    assert joined and not any("voter" in columns for columns in joined)


def test_typing(spark):
    rng = random.Random(8)
    elements = [("a", "ALU", dna(rng, 300)), ("b", "LINE1", dna(rng, 600)), ("c", "SVA", dna(rng, 400))]
    consensus = spark.createDataFrame([(i, n, f, s) for i, (n, f, s) in enumerate(elements)], "cid int, name string, family string, seq string")
    changed = list(elements[1][2][200:260])
    changed[30] = "A" if changed[30] != "A" else "C"
    rows = [("alu", elements[0][2][50:110]), ("line", "".join(changed)), ("sva_back", flip(elements[2][2][100:180])), ("random", dna(rng, 60)), ("short", elements[0][2][:14]), ("runs", "A" * 60)]
    found = typing.hits(spark.createDataFrame(rows, "id string, seq string"), consensus).cache()
    got = {r.id: r for r in found.collect()}
    assert set(got) == {"alu", "line", "sva_back"}
    assert (got["alu"].cid, got["alu"].reverse, got["alu"].score, got["alu"].identity, got["alu"].element_start, got["alu"].element_end) == (0, False, 120, 1.0, 50, 110)
    assert got["line"].identity == 59 / 60 and got["line"].element_start == 200
    assert got["sva_back"].reverse and (got["sva_back"].element_start, got["sva_back"].element_end) == (100, 180)
    voted = typing.families(found.withColumn("site", F.lit(1)), consensus, ["site"]).first()
    assert voted.family == "SVA" and voted.voters == 1
