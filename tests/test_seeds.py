"""Seeds by index and by join, and alignments of many pairs at once."""

import random

from pyspark.sql import functions as F

from locusframe.functions import alignment, seeds
from locusframe.plans import typing

from .simulate import dna


def slow_alignment(q, t):
    """Best local alignment cell by cell: score, and the first end by query, then target."""
    none = -(10**9)
    h, e, f, best = {}, {}, {}, (0, 0, 0)
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            if not i or not j:
                h[i, j], e[i, j], f[i, j] = 0, none, none
                continue
            e[i, j] = max(h[i, j - 1] - 7, e[i, j - 1] - 2)
            f[i, j] = max(h[i - 1, j] - 7, f[i - 1, j] - 2)
            h[i, j] = max(0, e[i, j], f[i, j], h[i - 1, j - 1] + (2 if q[i - 1] == t[j - 1] != "N" else -3))
            if h[i, j] > best[0]:
                best = (h[i, j], i, j)
    return best


def test_many_alignments_at_once(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(alignment, "CELLS", 9000)
    pairs = [("", "ACGT"), ("ACGT", ""), ("NNNN", "NNNN"), ("acgt", "ACGT"), ("A" * 30, "T" * 30)]
    for _ in range(60):
        base = dna(rng, rng.randrange(10, 60))
        other = list(base)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(other))
            other[at : at + rng.choice([0, 1, 5])] = dna(rng, rng.choice([0, 1, 7])) if rng.random() < 0.8 else "N"
            other = other or ["A"]
        pairs.append((base[rng.randrange(5) :], "".join(other) + dna(rng, rng.randrange(20))))
    got = alignment.align_all(*map(list, zip(*pairs, strict=True)))
    for (q, t), (score, matches, columns, q0, q1, t0, t1) in zip(pairs, got.tolist(), strict=True):
        expected = slow_alignment(q.upper(), t.upper())
        assert (score, q1, t1) == expected
        assert alignment.align(q, t) == (score, matches, columns, q0, q1, t0, t1)  # alone as among others
        gaps = columns - matches
        assert matches <= min(q1 - q0, t1 - t0) and max(q1 - q0, t1 - t0) <= columns and score <= 2 * matches - 2 * gaps + 4 * (columns - matches)
    assert alignment.align("ACGTACGTAC", "GGACGTACGTACGG")[:3] == (20, 10, 10)
    assert alignment.align("ACGTACGTTTGCATGCA", "ACGTACGTGCATGCA") == (21, 15, 17, 0, 17, 0, 15)


def test_seeds_by_index_as_by_join(spark, monkeypatch):
    rng = random.Random(4)
    elements = [dna(rng, 300), "ACACACACACACACACAC" * 4, dna(rng, 40) + "A" * 30 + dna(rng, 40), "short", None]
    clips = [elements[i % 3][at : at + n] for i in range(60) for at, n in [(rng.randrange(60), rng.randrange(5, 90))]]
    clips += ["", None, "N" * 40, "acgtacgtacgtac", dna(rng, 50) + "N" + elements[0][:30]]
    sequences = spark.createDataFrame(list(enumerate(clips)), "id long, seq string").repartition(3)
    references = spark.createDataFrame([(10 + i, s) for i, s in enumerate(elements)], "ref long, seq string")
    quick = [sorted(map(tuple, f(sequences, references).collect())) for f in (seeds.seeds, seeds.bands)]
    monkeypatch.setattr(seeds, "PART_BASES", 100)
    parts = [sorted(map(tuple, f(sequences, references).collect())) for f in (seeds.seeds, seeds.bands)]
    monkeypatch.setattr(seeds, "INDEX_BASES", 0)
    joined = [sorted(map(tuple, f(sequences, references).select(*names).collect())) for f, names in ((seeds.seeds, ["id", "ref", "diagonal"]), (seeds.bands, ["id", "ref", "seeds", "first", "last"]))]
    assert quick == parts == joined and len(quick[0]) > 1000 and len(quick[1]) > 40


def test_hits_by_index_as_by_join(spark, monkeypatch):
    rng = random.Random(6)
    elements = [dna(rng, 280), dna(rng, 300)]
    consensus = spark.createDataFrame([(i, f"e{i}", "ALU", s) for i, s in enumerate(elements)], "cid int, name string, family string, seq string")
    clips = []
    for i in range(40):
        at = rng.randrange(200)
        seq = list(elements[i % 2][at : at + rng.randrange(20, 70)])
        seq[rng.randrange(len(seq))] = rng.choice("ACGT")
        clips.append((f"c{i}", "".join(seq)))
    df = spark.createDataFrame(clips, "id string, seq string")
    quick = sorted(map(tuple, typing.hits(df, consensus).collect()))
    monkeypatch.setattr(seeds, "INDEX_BASES", 0)
    assert sorted(map(tuple, typing.hits(df, consensus).collect())) == quick and len(quick) >= 35
    assert typing.hits(df.where(F.lit(False)), consensus).count() == 0
