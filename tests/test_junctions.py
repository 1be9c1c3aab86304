"""Junction contigs and tracts: kernels on made-up sequences."""

import random

from pyspark.sql import functions as F

from locusframe.functions import assembly as asm
from locusframe.functions import sequences as sq
from locusframe.functions import tracts
from locusframe.plans import junctions, mates, typing

from .simulate import dna, flip


def pieces(seq, size=80, step=7):
    return [seq[i : i + size] for i in range(0, len(seq) - size + 1, step)]


def test_a_walk_follows_most_reads():
    rng = random.Random(2)
    seq = dna(rng, 300)
    grown = asm.Successors(pieces(seq) * 2).contig(seq[:21])
    assert seq.startswith(grown) and len(grown) > 290
    fork = [seq[:100] + "ACGTACGTTGCA" * 3] * 2 + [seq[:100] + "TTGGCCAATCGA" * 3] * 2
    assert asm.Successors(fork).contig(seq[:21]) == seq[:100]
    assert asm.Successors([seq]).contig(seq[:21]) == seq[:21]  # one read isn't enough
    loop = (seq[:50] * 6)[:280]
    assert len(asm.Successors([loop] * 2).contig(loop[:21])) <= 50 + 21
    assert "N" not in asm.Successors([seq[:60] + "N" + seq[61:]] * 3).contig(seq[:21])


def test_a_walk_passes_long_runs():
    rng = random.Random(3)
    left, right = dna(rng, 60) + "C", "G" + dna(rng, 60)
    reads = [left[-40:] + "A" * n + right[:40] for n in (28, 30, 30, 31, 33)] * 2
    contig = asm.Successors(reads).contig(left[-40:][:21])
    assert contig.startswith(left[-40:] + "A" * 30 + "G")


def test_junctions_of_both_sides():
    rng = random.Random(7)
    ref, insert = dna(rng, 500), "G" + dna(rng, 118) + "C" + "A" * 15
    left, right = 260, 248  # a duplicated site of 12 bases
    hap = ref[:left] + insert + ref[right:]
    found = pieces(hap[180:480], 70, 5)
    one, two, tail = asm.assemble(found, found, [flip(x) for x in found[::3]], ref, 1000, 1000 + left, 1000 + right)
    into = next(k for k in range(20) if insert[k] != ref[left + k])
    back = next(k for k in range(20) if insert[-1 - k] != ref[right - 1 - k])
    assert one.junction == 1000 + left + into and ref[left - 20 : left] in one.contig and insert[into:40] in one.insert
    assert two.junction == 1000 + right - back and ref[right : right + 20] in two.contig
    assert tail == (15 - back, "A")
    assert asm.assemble([], [], [], ref, 1000, 1000 + left, None) == (None, None, None)


def slow_contig(reads, seed):
    """The walk by its rules alone: each letter by counting in all reads anew."""
    known = lambda k: sum(r[i : i + 21] == k for r in reads for i in range(len(r) - 20)) if not set(k) - set("ACGT") else 0
    contig, passed = seed, {seed}
    while len(contig) < 600:
        n = {b: known(contig[-20:] + b) for b in "ACGT"}
        best = max(n, key=n.get)
        rivals = [c for b, c in n.items() if b != best and c >= 2]
        if n[best] < 2 or any(2 * c >= n[best] for c in rivals):
            break
        if contig[-20:] != best * 20:
            if contig[-20:] + best in passed:
                break
            passed.add(contig[-20:] + best)
            contig += best
            continue
        run = next(i for i in range(len(contig), 0, -1) if contig[i - 1] != best) if set(contig) != {best} else 0
        told = []
        for r in reads:
            for i in range(len(r) - 8 if run >= 8 else 0):
                if r[i : i + 8] == contig[run - 8 : run]:
                    end = i + 8
                    while end < len(r) and r[end] == best:
                        end += 1
                    if end < len(r) and end - i - 8 >= len(contig) - run:
                        told.append((end - i - 8, r[end]))
        if len(told) < 2:
            break
        letters = sorted(x for _, x in told)
        after = max(sorted(set(letters)), key=letters.count)
        contig += best * (sorted(n for n, _ in told)[(len(told) - 1) // 2] - (len(contig) - run)) + after
        if after == "N":
            break
    return contig[:600]


def test_contigs_as_by_counting_anew():
    rng = random.Random(11)
    for _ in range(60):
        seq = dna(rng, 40) + rng.choice("ACGT") * rng.choice([0, 18, 22, 27]) + dna(rng, 30) + rng.choice(["", "A" * 25 + "N", dna(rng, 15) * 2]) + dna(rng, 30)
        reads = []
        for _ in range(30):
            at = rng.randrange(len(seq) - 40)
            read = list(seq[at : at + rng.randrange(40, 75)])
            for _ in range(rng.randrange(3)):
                read[rng.randrange(len(read))] = rng.choice("ACGTN")
            if rng.random() < 0.3:
                del read[rng.randrange(len(read))]
            reads.append("".join(read))
        seed = seq[5:26]
        assert asm.Successors(reads).contig(seed) == slow_contig(reads, seed)


def test_given_assembly():
    """A 12-base site, an element and A30, with estimates 2 bases off: junctions 1200 and 1188, tail A30."""
    rng = random.Random(13)
    while True:
        ref, element = dna(rng, 400), dna(rng, 100)
        if element[0] != ref[200] and ref[187] != "A" and element[-1] != "A":
            break
    hap = ref[:200] + element + "A" * 30 + ref[188:]
    reads = [hap[i : i + 100] for i in range(80, 360, 4)]
    one, two, tail = asm.assemble(reads, reads, [], ref, 1000, 1202, 1186)
    assert (one.junction, two.junction, tail) == (1200, 1188, (30, "A"))
    assert ref[188:200] == hap[188:200] and one.insert.startswith(element[:40]) and two.insert.endswith("A" * 30)


def test_anchors_of_a_window():
    window = tracts.Window("ACGGTGCATTGAC" + "GATCCCGTAG" * 2)
    assert window.explains("ACGTGCAT", 0, 30) is True and window.explains("ACGTGGCAT", 0, 31) is False
    assert window.explains("ACGTTGCAT", 1, 40) is True and window.explains("ACGTGCAT", 1, 41) is False
    assert window.explains("ATATATATATAT", 0, 0) is None and window.explains("ACGTT", 0, 0) is None
    assert window.explains("TGACGTGCAT", 0, 36) is True and window.explains("TGACGTGCAT", 0, 37) is False  # two letters further in
    assert tracts.Window("C" + "A" * 10 + "G").has_run(14, "A") and not tracts.Window("C" + "A" * 10 + "G").has_run(15, "A") and not tracts.Window("C" + "A" * 9 + "G").has_run(5, "A")


def test_flanks_allow_lone_variants():
    assert asm.on_flank("ACGTAC", "ACGTTT") == 4
    assert asm.on_flank("ACGTACGTACGTTTTT", "ACGAACGTACGTAAAA") == 12
    assert asm.on_flank("ACGT", "ACGT") is None and asm.on_flank("ACGTT", "ACGTA") == 4


def test_tails_of_inserts():
    assert asm.tail_of("A" * 12 + "CGCG", False, 10, 0.8) == (12, "A") and asm.tail_of("CGCG" + "T" * 12, True, 10, 0.8) == (12, "T")
    assert asm.tail_of("A" * 12, False, 10, 0.8) is None and asm.tail_of("A" * 9 + "CGCGCG", False, 10, 0.8) is None


def test_clips_of_longer_tracts(spark):
    rng = random.Random(5)
    before, after = dna(rng, 100) + "C", "G" + dna(rng, 100)
    ref = before + "A" * 15 + after
    end = len(before) + 15
    longer = "A" * 12 + after[:40]  # the read has a longer run than the reference
    rows = [(1, longer, 1, end, "A", 12), (2, "A" * 12 + dna(rng, 40), 1, end, "A", 12), (3, "A" * 30, 1, end, "A", 30), (4, (before[-40:] + "A" * 12), 0, len(before), "A", 12), (5, "AC" * 10, 1, end, None, None)]
    df = spark.createDataFrame([(*r, ref) for r in rows], "id int, clip string, side int, at long, base string, length int, win string")
    got = {r.id: r.t for r in df.select("id", tracts.against_reference(F.col("clip"), F.col("side"), F.col("at"), F.col("base"), F.col("length"), F.col("win")).alias("t")).collect()}
    assert got[1].found is True and got[1].beyond_tail is True and got[1].homopolymer is True
    assert got[2].found is False
    assert got[3].found is None and got[3].beyond_tail is False and got[3].homopolymer is True
    assert got[4].found is True
    assert got[5].found is None and got[5].beyond_tail is None and got[5].homopolymer is False
    assert tracts.compressed("AACCCG") == ("ACG", [0, 2, 5, 6])


def test_tandem_repeats_are_flagged(spark):
    rng = random.Random(9)
    before, after = dna(rng, 600) + "C", "G" + dna(rng, 600)
    ref = before + "A" * 14 + after
    contigs = spark.createDataFrame([(0, "chr1", len(ref))], "rank int, name string, length long")
    reference = spark.createDataFrame([("chr1", 0, ref)], "contig string, chunk long, seq string")
    at = len(before) + 14
    schema = "contig int, cluster_start long, left_junction long, right_junction long, breakpoint long, filters array<string>"
    candidates = spark.createDataFrame([(0, 1, at, None, at, []), (0, 2, at, None, at, ["no_tail"])], schema)
    clips = [(0, 1, f"a{k}", 1, at, ("A", 12), "A" * 12 + after[: 30 + k]) for k in range(3)] + [(0, 2, f"b{k}", 1, at, ("A", 12), "A" * 12 + dna(rng, 40)) for k in range(3)]
    frame = spark.createDataFrame(clips, "contig int, cluster_start long, voter string, side int, position long, tail struct<base:string,length:int>, seq string")
    got = {r.cluster_start: r.filters for r in junctions.tandem_repeats(frame, candidates, contigs, reference).collect()}
    assert got == {1: ["tandem_repeat"], 2: ["no_tail"]}


def test_reference_copies(spark):
    rng = random.Random(10)
    element = dna(rng, 300)
    ref = dna(rng, 1000) + element[100:260] + dna(rng, 1000)
    contigs = spark.createDataFrame([(0, "chr1", len(ref))], "rank int, name string, length long")
    reference = spark.createDataFrame([("chr1", 0, ref)], "contig string, chunk long, seq string")
    consensus = spark.createDataFrame([(0, "x", "ALU", element), (1, "y", "SVA", dna(rng, 300))], "cid int, name string, family string, seq string")
    schema = "contig int, cluster_start long, breakpoint long, family string, by_mates boolean, filters array<string>, checked_mates long, tail_mates long"
    rows = [(0, 1, 900, "ALU", True, [], 9, 4), (0, 2, 900, "SVA", True, [], 9, 4), (0, 3, 300, "ALU", True, [], 9, 4), (0, 4, 900, "ALU", False, [], 9, 0), (0, 5, 900, "ALU", False, ["no_junction"], 9, 2)]
    got = {r.cluster_start: (r.reference_copy, r.checked_mates, r.tail_mates) for r in mates.reference_copies(spark.createDataFrame(rows, schema), consensus, contigs, reference).collect()}
    assert got == {1: (True, 9, 4), 2: (False, 5, 0), 3: (False, 5, 0), 4: (False, 9, 0), 5: (True, 9, 2)}


def test_masked_bases_and_bare_clips(spark):
    df = spark.createDataFrame([("acgt", "I!I+"), ("acgt", "II"), ("acgt", None)], "s string, q string")
    assert [r.m for r in df.select(sq.masked_bases(F.col("s"), F.col("q")).alias("m")).collect()] == ["ANGT", "ACGT", "ACGT"]
    clips = spark.createDataFrame([("CGAA", "A", True), ("AACG", "A", False), ("TTAC", "T", False), ("TTAC", None, False)], "c string, b string, e boolean")
    assert [r.x for r in clips.select(sq.without_tail(F.col("c"), F.col("b"), F.col("e")).alias("x")).collect()] == ["CG", "CG", "AC", "TTAC"]


def test_best_hits(spark):
    rows = [("s", 3, True, 50, "ALU"), ("s", 1, True, 50, "ALU"), ("s", 1, False, 50, "SVA"), ("s", 0, False, 49, "ALU")]
    df = spark.createDataFrame(rows, "k string, cid int, reverse boolean, score int, family string")
    assert tuple(typing.best_hits(df, ["k"]).first()) == ("s", 1, False, 50, "SVA")
