"""From SAM text to candidates and reports."""

import gzip
import hashlib
import json as js
import random

import pytest
from pyspark.sql import functions as F

from locusframe import cli
from locusframe.options import Calling, Options, Reading
from locusframe.plans import extract, junctions, regions, scan
from locusframe.sinks import report
from locusframe.sources import text

from .bamfile import write_bam
from .simulate import simulate


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scan")
    ref, element = simulate(folder / "reads.sam")
    (folder / "elements.fa").write_text(f">AluMade#SINE/Alu\n{element}\n>L1Made#LINE/L1\n{element[::-1]}\n")
    (folder / "targets.bed").write_text("# probes\ntrack x\nchr1\t9700\t9900\tone\nchr1 10100 10300 two\n\n")
    (folder / "ref.fa").write_text(">chr1 made up\n" + "\n".join(ref[i : i + 60] for i in range(0, len(ref), 60)) + "\n>chr2\nACGT\n")
    contigs, samples = text.sam_header(spark, str(folder / "reads.sam"))
    reads = text.sam_reads(spark, str(folder / "reads.sam"), contigs).cache()
    return folder, ref, contigs.cache(), samples, reads


def test_sources(spark, sample):
    folder, ref, contigs, samples, reads = sample
    assert [tuple(r)[:3] for r in contigs.orderBy("rank").collect()] == [(0, "chr1", 20000), (1, "chr2", 5000)]
    assert text.sample_name(samples, "stem") == ("made_up", None)
    probes = text.bed(spark, str(folder / "targets.bed"))
    assert {tuple(r) for r in probes.collect()} == {("chr1", 9700, 9900, "one", 3, None), ("chr1", 10100, 10300, "two", 4, None)}
    chunks = text.fasta(spark, str(folder / "ref.fa"), 7000)
    assert [(r.chunk, len(r.seq)) for r in chunks.where("contig = 'chr1'").orderBy("chunk").collect()] == [(0, 7000), (1, 7000), (2, 6000)]
    rows = spark.createDataFrame([("chr1", 6990, 7010), ("chr1", -5, 3), ("chr2", 10, 20)], "contig string, a long, b long")
    got = {(r.contig, r.a): r.window for r in text.bases(rows, chunks, "contig", F.col("a"), F.col("b"), chunk=7000).collect()}
    assert got == {("chr1", 6990): ref[6990:7010], ("chr1", -5): ref[:3], ("chr2", 10): None}
    assert reads.where("start is null").count() == 0
    bad = folder / "bad.bed"
    bad.write_text("chr1\t5\nchr1\tx\t9\nchr1\t9\t9\n")
    assert text.bed(spark, str(bad)).where("error is not null").count() == 3
    with pytest.raises(ValueError, match="line 1: fewer"):
        text.checked_bed(spark, str(bad))
    bad.write_text("# nothing\n")
    with pytest.raises(ValueError, match="no target"):
        text.checked_bed(spark, str(bad))
    (folder / "packed").write_bytes(gzip.compress(b"track\nchr1\t5\t9\n"))
    assert [tuple(r) for r in text.checked_bed(spark, str(folder / "packed")).collect()] == [("chr1", 5, 9, None)]


@pytest.fixture
def small_pieces(spark):
    """Files are read in pieces of 700 bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_contigs_over_many_pieces(spark, tmp_path, small_pieces):
    rng = random.Random(5)
    contigs = {f"c{i}": "".join(rng.choices("ACGTn", k=n)) for i, n in enumerate([5000, 0, 1, 999, 1000, 1001, 7, 3000])}
    lines = []
    for name, seq in contigs.items():
        width = rng.choice([60, 61, 1000])
        lines += [f">{name} some > more", *(seq[i : i + width] + " " * rng.randrange(2) for i in range(0, len(seq), width)), ""]
    (tmp_path / "many.fa").write_text("\n".join(lines))
    assert spark.read.text(str(tmp_path / "many.fa")).rdd.getNumPartitions() > 10
    chunks = text.fasta(spark, str(tmp_path / "many.fa"), 333)
    got = {}
    for r in chunks.orderBy("contig", "chunk").collect():
        assert len(r.seq) <= 333 and r.chunk == len(got.get(r.contig, "")) // 333
        got[r.contig] = got.get(r.contig, "") + r.seq
    assert got == {k: v.upper() for k, v in contigs.items() if v}


def test_chains_over_many_pieces(spark, tmp_path, small_pieces):
    rng = random.Random(6)
    lines, expected = ["# made up"], []
    for k in range(30):
        t, q = rng.randrange(1000), rng.randrange(1000)
        lines.append(f"chain {k * 10} chr{k % 3} 90000 + {t} 80000 other{k} 70000 {'+-'[k % 2]} {q} 60000 {k}")
        for i in range(n := rng.randrange(1, 60)):
            size, dt, dq = rng.randrange(1, 90), rng.randrange(9), rng.randrange(9)
            lines.append(f"{size}\t{dt}\t{dq}" if i < n - 1 else str(size))
            expected.append((f"chr{k % 3}", t, t + size, k * 10, k, f"other{k}", 70000, "+-"[k % 2], q))
            t, q = t + size + dt, q + size + dq
        lines.append("")
    (tmp_path / "many.chain").write_text("\n".join(lines))
    assert sorted(map(tuple, text.chain(spark, str(tmp_path / "many.chain")).collect())) == sorted(expected)


def test_reads_count_in_the_order_of_the_file(spark, tmp_path, small_pieces):
    names = [f"r{i}" for i in range(400)]
    random.Random(7).shuffle(names)
    rows = [f"{n}\t0\tchr1\t101\t60\t30M20S\t*\t0\t0\t{'A' * 50}\t{'I' * 50}" for n in names]
    (tmp_path / "many.sam").write_text("@SQ\tSN:chr1\tLN:5000\n" + "\n".join(rows) + "\n")
    contigs, _ = text.sam_header(spark, str(tmp_path / "many.sam"))
    reads = text.sam_reads(spark, str(tmp_path / "many.sam"), contigs)
    assert [r.name for r in reads.orderBy("at").select("name").collect()] == names
    requests = spark.createDataFrame([(0, 1, 50, 300, 130, None)], "q_contig int, q_site long, low long, high long, left long, right long")
    known = junctions.window_reads(reads, Reading()).withColumn("seq", F.col("name"))
    kept = junctions.junction_reads(requests, known, ["q_contig", "q_site"], ["at"])
    assert [r.seq for r in kept.where("role = 'left'").orderBy("rank").collect()] == names[: junctions.MOST_READS]


def test_other_tables(spark, tmp_path):
    (tmp_path / "a.chain").write_text("chain 900 chr1 1000 + 100 200 chrA 900 + 50 155 7\n40 10 15\n50\n\nchain 1000 chr1 1000 + 400 450 chrB 500 - 10 60 8\n50\n")
    got = {tuple(r) for r in text.chain(spark, str(tmp_path / "a.chain")).collect()}
    assert got == {("chr1", 100, 140, 900, 7, "chrA", 900, "+", 50), ("chr1", 150, 200, 900, 7, "chrA", 900, "+", 105), ("chr1", 400, 450, 1000, 8, "chrB", 500, "-", 10)}
    (tmp_path / "t.csv").write_text("CHROM,POS,ID,TE_Designation,FORMAT,S1,S2,Caller_Count\nchr2,500,m1,ALU,GT,0|1,,3\n")
    assert {tuple(r) for r in text.truth(spark, str(tmp_path / "t.csv")).collect()} == {("m1", "2", 500, "ALU", "S1", "0|1")}
    (tmp_path / "g.gtf").write_text('#x\nchr1\ta\texon\t11\t20\t.\t+\t.\tid "x"\nchr1\ta\tgene\t1\t90\t.\t+\t.\t.\n')
    assert [tuple(r) for r in text.gtf(spark, str(tmp_path / "g.gtf")).collect()] == [("chr1", "exon", 10, 20)]
    (tmp_path / "c.fa").write_text(">AluY#SINE/Alu x\nacgt\nNN12\n>L1HS\nAC\n>Other#DNA/hAT\nACGT\n>SVA_A#Retroposon/SVA\n\n")
    assert [tuple(r) for r in text.consensus(spark, str(tmp_path / "c.fa")).collect()] == [(0, "AluY", "ALU", "ACGTNN"), (1, "L1HS", "LINE1", "AC")]


def test_regions(spark, sample):
    folder, _, contigs, _, _ = sample
    probes = text.bed(spark, str(folder / "targets.bed"))
    got = regions.scan_regions(probes, contigs, 300)
    assert [tuple(r) for r in got.collect()] == [(0, 9400, 10600, 2)]
    assert [tuple(r)[1:3] for r in regions.restrict(got, contigs, "chr1:9,501-10,000").collect()] == [(9500, 10000)]
    other = probes.withColumn("contig", F.lit("1"))
    assert all(r.restyled for r in regions.unknown_probes(other, contigs).collect())


def test_signals(spark, sample):
    folder, _, contigs, _, reads = sample
    targets = regions.scan_regions(text.bed(spark, str(folder / "targets.bed")), contigs, 300)
    found, outcomes, sizes = extract.signals(reads, targets, Options().reading)
    row = sizes.first()
    assert 280 <= row.median <= 320 and row.threshold > row.median
    kinds = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    assert kinds["soft_clip"] > 10 and kinds["mate_unmapped"] > 20
    tails = found.where("kind = 'soft_clip' and side = 0").select("tail.base", "position").distinct().collect()
    assert {r.position for r in tails} == {9988} and "A" in {r.base for r in tails}
    assert {r.outcome for r in outcomes.collect()} == {"kept", "unmapped"}


def test_scan_finds_the_insertion(spark, sample):
    folder, _, contigs, _, reads = sample
    probes = text.bed(spark, str(folder / "targets.bed"))
    options = Options(calling=Calling(min_typed_clips=0, profile="discovery"))
    with pytest.raises(ValueError, match="exome needs"):
        scan.scan(reads, contigs, probes, Options(calling=Calling(min_typed_clips=0)))
    with pytest.raises(ValueError, match="min_typed_clips"):
        scan.scan(reads, contigs, probes, Options())
    got = scan.scan(reads, contigs, probes, options)
    assert got.count() == 1
    row = got.first()
    assert (row.left_junction, row.right_junction, row.tsd) == (10000, 9988, 12)
    assert row.breakpoint in (9988, 10000) and row.tail_clips >= 2 and row.confidence == "high"
    assert row.genotype.call == "0/1" and row.alt_reads > 5 and row.ref_reads > 5 and row.depth > 20


@pytest.fixture(scope="module")
def whole(spark, sample):
    """A scan with consensus and reference, and its default demands."""
    folder, _, contigs, _, reads = sample
    probes = text.bed(spark, str(folder / "targets.bed"))
    consensus, reference = text.consensus(spark, str(folder / "elements.fa")), text.fasta(spark, str(folder / "ref.fa")).where("contig = 'chr1'")
    return scan.run(reads, contigs, probes, Options(), consensus, reference)


def test_scan_types_and_assembles(sample, whole):
    folder, ref, _, _, _ = sample
    inserted = (folder / "elements.fa").read_text().split()[1] + "A" * 30
    row = whole.candidates.collect()[0]
    assert whole.candidates.count() == 1 and row.filters == []
    assert (row.family, row.subfamily, row.reverse, row.by_mates) == ("ALU", "AluMade", False, False)
    assert row.typed_clips >= 2 and row.identity == 1.0 and row.element_start == 0
    assert row.checked_mates >= 20 and row.mei_mates > 0.7 * row.checked_mates and row.mate_identity > 0.99 and not row.reference_copy
    # the insert's first and last bases that agree with the reference count as flanks
    into = next(k for k in range(30) if inserted[k] != ref[10000 + k])
    back = next(k for k in range(30) if inserted[-1 - k] != ref[9987 - k])
    assert row.assembled == "both" and (row.left_junction, row.right_junction) == (10000 + into, 9988 - back)
    assert row.tsd_bases == ref[9988 - back : 10000 + into] and row.tsd == 12 + into + back and (row.tail_base, row.tail_run) == ("A", len(inserted) - len(inserted.rstrip("A")) - back)
    assert row.ref_base == ref[row.breakpoint - 1] and row.qual >= 10 and row.confidence == "high"
    assert {r.stage: r.n for r in whole.stages.collect()}["passed"] == 1
    assert {r.outcome for r in whole.outcomes.collect()} == {"kept", "unmapped"} and whole.sizes.first().n > 100


def test_reports(spark, sample, whole):
    folder, _, contigs, _, _ = sample
    got = whole.candidates
    heading = report.Heading("made_up", report.command_line(["scan", "/data/x/reads.sam"]), (("chr1", 20000),), "ref.fa")
    assert heading.command == "scan reads.sam"
    line = dict(zip(report.TSV_COLUMNS, report.tsv(got).first().line.split("\t"), strict=True))
    assert (line["id"], line["contig"], line["filter"], line["family"], line["typed_by"], line["assembled"], line["strand"]) == ("MEI_1", "chr1", "PASS", "ALU", "clips", "both", "+")
    assert line["cipos"] == "." and line["element_start"] == "1" and line["tsd_length"] == str(len(line["tsd"])) and "None" not in line.values() and line["identity"] == "1.000"
    assert report.bed(got).first().line.split("\t") == ["chr1", line["right_junction"], line["left_junction"], "MEI_1", line["support"], "+", "high"]
    path = folder / "out.vcf.gz"
    assert report.write(got, str(path), "vcf", heading) == 1
    lines = gzip.open(path, "rt").read().splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-1].split("\t")[6] == "PASS" and lines[-1].split("\t")[4] == "<INS:ME:ALU>" and not list(folder.glob(".*.part"))
    calls = text.calls_vcf(spark, str(path)).first()
    assert calls.contig == "1" and calls["info"]["TSD_LEN"] == line["tsd_length"] and calls["info"]["MEINFO"].startswith("AluMade,1,")
    declared = {x.split("ID=")[1].split(",")[0] for x in lines if x.startswith("##INFO")}
    assert len(declared) == 22 and set(calls["info"]) <= declared
    nested = report.nested_signals(whole.signals, contigs, anonymize=True)
    assert report.write(got, str(folder / "out.json"), "json", heading, nested) == 1
    told = js.loads((folder / "out.json").read_text())
    one = told["candidates"][0]
    assert told["sample"] == "made_up" and one["filter"] == ["PASS"] and one["assembly"]["assembled"] == "both" and one["cipos"] is None
    assert one["signals"][0]["read"] == "read_1" and {s["kind"] for s in one["signals"]} == {"soft_clip", "mate_unmapped"}
    names = list(dict.fromkeys(s["read"] for s in one["signals"]))
    assert names == [f"read_{k + 1}" for k in range(len(names))] and any(s.get("mei_mate") for s in one["signals"])
    assert all("mapq" in s and ("tail" in s or True) for s in one["signals"])
    for form in ("tsv", "bed"):
        assert report.write(got, str(folder / f"out.{form}"), form, heading) == 1
    assert text.calls_tsv(spark, str(folder / "out.tsv")).first().family == "ALU"
    with pytest.raises(ValueError, match="formats"):
        report.write(got, "x", "xml", heading)


def test_partitions_do_not_matter(spark, sample):
    folder, _, contigs, _, reads = sample
    probes = text.bed(spark, str(folder / "targets.bed"))
    options = Options(calling=Calling(min_typed_clips=0, profile="discovery", keep_filtered=True))
    lines = [sorted(r.line for r in report.tsv(scan.scan(x, contigs, probes, options)).collect()) for x in (reads, reads.repartition(7))]
    assert lines[0] == lines[1] and lines[0]


def test_unknown_contigs_are_errors(spark, sample):
    folder, _, contigs, _, reads = sample
    probes = text.bed(spark, str(folder / "targets.bed")).withColumn("contig", F.lit("1"))
    with pytest.raises(ValueError, match="other style"):
        scan.scan(reads, contigs, probes, Options(calling=Calling(min_typed_clips=0)))


def test_command_line(spark, sample, capsys, monkeypatch):
    folder, _, _, _, reads = sample
    line = ["scan", "--bam", str(folder / "reads.sam"), "--bed", str(folder / "targets.bed"), "--output", str(folder / "cli.vcf"), "--format", "vcf", "--min-typed-clips", "0", "--profile", "discovery", "--keep-filtered"]
    arguments = cli.parser().parse_args(line)
    assert cli.options(arguments) == Options(calling=Calling(min_typed_clips=0, profile="discovery", keep_filtered=True))
    assert cli.run(spark, arguments, line) >= 1
    lines = (folder / "cli.vcf").read_text().splitlines()
    assert "##command=scan --bam reads.sam --bed targets.bed --output cli.vcf --format vcf --min-typed-clips 0 --profile discovery --keep-filtered" in lines and lines[-1].startswith("chr1\t")
    write_bam(folder / "packed.bam", (folder / "reads.sam").read_text().splitlines(), 5_000)
    again = [str(folder / "packed.bam") if x.endswith("reads.sam") else x for x in line]
    taken = []
    monkeypatch.setattr(cli.scan, "run", lambda reads, *rest: taken.append(reads) or [].pop())
    with pytest.raises(IndexError):  # what follows is as for text
        cli.run(spark, cli.parser().parse_args(again), again)
    assert sorted(map(repr, taken[0].drop("at").select(*sorted(set(reads.columns) - {"at"})).collect())) == sorted(map(repr, reads.select(*sorted(set(reads.columns) - {"at"})).collect()))
    monkeypatch.undo()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["scan", "--bam", "x"])
    with pytest.raises(ValueError, match="min_mapq"):
        cli.options(cli.parser().parse_args([*line, "--min-mapq", "300"]))


def test_references_are_compared(spark, sample):
    folder, ref, contigs, _, _ = sample
    chunks = text.fasta(spark, str(folder / "ref.fa"), 7000)
    known = spark.createDataFrame([(0, "chr1", 20000, hashlib.md5(ref.encode()).hexdigest()), (1, "chr2", 4, None), (2, "chr3", 9, None)], "rank int, name string, length long, m5 string")
    told = lambda header, *names: {(r.name, r.reason) for r in regions.changed_contigs(header, chunks, *names).collect()}
    on = lambda *names: spark.createDataFrame([(n,) for n in names], "contig string")
    assert told(known) == {("chr3", "missing")} and told(known, on("chr1", "chr2"), on("chr1")) == set()
    assert told(known, on("chr1", "chr3"), on("chr1")) == {("chr3", "missing")}
    other = known.withColumn("m5", F.lit("0"))
    assert told(other, on("chr1"), on("chr1")) == {("chr1", "digest")} and told(other, on("chr1"), on()) == set()
    short = known.withColumn("length", F.lit(19_999).cast("long"))
    assert told(short, on("chr1"), on("chr1")) == {("chr1", "length")} and told(short, on(), on()) == set()


def test_targets_of_another_assembly(spark):
    targets = spark.createDataFrame([("chr1", 110, 130), ("chr1", 135, 160), ("chr1", 100, 260)], "contig string, start long, end long")
    blocks = spark.createDataFrame([("chr1", 100, 140, 9, 1, "chrA", 900, "+", 500), ("chr1", 150, 300, 9, 1, "chrA", 900, "+", 550), ("chr1", 400, 600, 9, 2, "chrB", 1000, "-", 0)], "source string, s long, e long, score long, chain long, q_contig string, q_size long, strand string, q_start long")
    more = targets.unionByName(spark.createDataFrame([("chr1", 400, 600)], "contig string, start long, end long"))
    assert [tuple(r) for r in regions.derived_targets(more, blocks).collect()] == [("chrA", 510, 530), ("chrA", 535, 560), ("chrA", 550, 610), ("chrB", 850, 950)]
