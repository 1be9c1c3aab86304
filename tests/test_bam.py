"""BAM files against the same reads as SAM text."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from locusframe.sources import bam, text

from .bamfile import block, record, write_bam

HEAD = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:200000\tM5:ABCDEF", "@SQ\tSN:chr2\tLN:50000", "@SQ\tSN:chr3\tLN:9000", "@RG\tID:a\tSM:one", "@CO\tx"]


def made_up(n=300, seed=3):
    """Sorted reads of many kinds."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        contig, bases = rng.randrange(3), rng.choice([1, 7, 100, 100, 151])
        at = rng.randrange(1, 8000)
        left = rng.randrange(bases)
        cigar = rng.choice([f"{bases}M", f"{left}S{bases - left}M" if left else f"{bases}M", f"{bases}M3D" if bases > 1 else "1M", "*"])
        seq = "".join(rng.choice("ACGTN") for _ in range(bases))
        qual = rng.choice(["*", "".join(chr(33 + rng.randrange(60)) for _ in range(bases))])
        mate = rng.choice([("=", at + 50), ("chr2", 70), ("*", 0)])
        tags = rng.sample(["MQ:i:37", "MQ:i:300", "MC:Z:30M2I", "SA:Z:chr2,5,+,3S9M,1,0", "NM:i:70000", "XF:f:0.5", "XA:A:c", "XB:B:I,1,2,70000", "RG:Z:a"], rng.randrange(6))
        line = f"r{k}\t{rng.choice([0, 16, 65, 99, 147, 256, 1024])}\tchr{contig + 1}\t{at}\t{rng.choice([0, 20, 60, 255])}\t{cigar}\t{mate[0]}\t{mate[1]}\t{rng.randrange(-500, 500)}\t{seq}\t{qual}" + "".join(f"\t{t}" for t in dict((t[:2], t) for t in tags).values())
        rows.append(((contig, at), line))
    rows.append(((3, 0), "lost\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*"))
    rows.append(((0, 3000), "long\t0\tchr1\t3000\t60\t" + "1M1D" * 40_000 + "\t*\t0\t0\t" + "ACGTA" * 8_000 + "\t*"))
    return HEAD + [line for _, line in sorted(rows, key=lambda x: x[0])]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    lines = made_up()
    (folder / "reads.sam").write_text("\n".join(lines) + "\n")
    write_bam(folder / "reads.bam", lines)
    contigs, samples = text.sam_header(spark, str(folder / "reads.sam"))
    known = sorted(map(repr, _plain(text.sam_reads(spark, str(folder / "reads.sam"), contigs))))
    return folder, lines, known


def _plain(reads):
    return reads.select(*[c for c in sorted(reads.columns) if c != "at"]).collect()


def test_header(spark, files):
    folder, _, _ = files
    for own, other in zip(bam.header(spark, str(folder / "reads.bam")), text.sam_header(spark, str(folder / "reads.sam")), strict=True):
        assert own.orderBy("rank").collect() == other.orderBy("rank").collect()
    assert bam.is_bam(str(folder / "reads.bam")) and not bam.is_bam(str(folder / "reads.sam"))


@pytest.mark.parametrize("size", [1 << 20, 20_000, 1_500])
def test_rows_are_those_of_the_text(spark, files, size):
    folder, lines, known = files
    reads = bam.reads(spark, str(folder / "reads.bam"), size)
    assert sorted(map(repr, _plain(reads))) == known
    assert [r["name"] for r in reads.orderBy("at").select("name").collect()] == [x.split("\t")[0] for x in lines if not x.startswith("@")]


def test_every_cut_of_a_file_gives_each_record_once(files, tmp_path):
    """Without Spark: ranges of 40 bytes, of which many hold no beginning of a record or block."""
    lines = [x for x in files[1] if not x.startswith("long")][:60]
    write_bam(tmp_path / "few.bam", lines, 120)
    schema = bam.StructType.fromDDL("name string")
    for size in (40, 41, 333):
        reader = bam.BamReader(str(tmp_path / "few.bam"), schema, size, 0)
        got = [n for p in reader.partitions() for b in reader.read(p) for n in b["name"].to_pylist()]
        assert got == [x.split("\t")[0] for x in lines if not x.startswith("@")]


def test_batches_cut_inside_records(files, monkeypatch):
    folder, lines, _ = files
    monkeypatch.setattr(bam, "BATCH_BYTES", 700)
    reader = bam.BamReader(str(folder / "reads.bam"), bam.StructType.fromDDL("name string, at struct<file: string, block: long, line: long>"), 5_000, 0)
    got = [(r["at"]["block"], r["at"]["line"], r["name"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [g[2] for g in got] == [x.split("\t")[0] for x in lines if not x.startswith("@")] and got == sorted(got, key=lambda g: g[:2])
    with bam._open(str(folder / "reads.bam")) as file:
        for place, within, name in got[::37]:
            data = b"".join(piece for _, piece in bam._blocks_between(file, bam.Place(place, within), bam.Place(file.size(), 0)))
            assert data[36:].startswith(name.encode() + b"\0")


def test_filters_and_columns(spark, files):
    folder, lines, _ = files
    path = str(folder / "reads.bam")
    asked = (F.col("contig") == 1) & (F.col("start") < 5000) & (F.col("end") > 2000) & (F.col("mapq") >= 20) & F.col("flag").isin(0, 16, 99)
    plain = bam.reads(spark, path, 3_000)
    want = sorted(map(repr, _plain(plain.where(asked))))
    assert want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(map(repr, _plain(bam.reads(spark, path, 3_000).where(asked)))) == want
        assert bam.reads(spark, path, 3_000).where("mapq is null and start is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    few = bam.reads(spark, path, 3_000, exclude_flags=256 | 1024, columns=["contig", "flag"])
    assert few.columns == ["contig", "flag"]
    assert sorted(map(repr, few.collect())) == sorted(map(repr, plain.where("(flag & 1280) = 0").select("contig", "flag").collect()))


def test_pushed_filters_leave_out_records_and_ranges(files, monkeypatch):
    folder, lines, _ = files
    reader = bam.PushingReader(str(folder / "reads.bam"), bam.StructType.fromDDL("contig int, seq string"), 3_000, 0)
    filters = [bam.EqualTo(("contig",), 2), bam.LessThan(("start",), 4000), bam.GreaterThan(("end",), 3000), bam.In(("flag",), (16, 65))]
    assert list(reader.pushFilters(filters)) == filters
    decoded, whole = [], bam._decoded
    monkeypatch.setattr(bam, "_decoded", lambda *a: decoded.append(len(a[1])) or whole(*a))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got and {r["contig"] for r in got} == {2}
    assert 0 < sum(decoded) < len(lines) / 2  # ranges of the other contigs aren't unpacked


def test_damage_is_told(files, tmp_path):
    folder, _, _ = files
    whole = (folder / "reads.bam").read_bytes()
    schema = bam.StructType.fromDDL("name string")
    read = lambda path, size=1 << 20: [b for r in [bam.BamReader(str(path), schema, size, 0)] for p in r.partitions() for b in r.read(p)]
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) - 40])
    with pytest.raises(ValueError, match="cut off"):
        read(tmp_path / "cut.bam")
    spoiled = bytearray(whole)
    spoiled[len(whole) // 2] ^= 255
    (tmp_path / "spoiled.bam").write_bytes(spoiled)
    with pytest.raises(ValueError):
        read(tmp_path / "spoiled.bam")
    (tmp_path / "text.bam").write_text("@HD\tVN:1.6\n")
    with pytest.raises(ValueError, match="no BAM"):
        read(tmp_path / "text.bam")
    (tmp_path / "empty.bam").write_bytes(block(b"BAM\x01" + struct.pack("<ii", 0, 0)))
    assert read(tmp_path / "empty.bam") == []
    with pytest.raises(ValueError, match="no columns"):
        bam.BamReader(str(folder / "reads.bam"), bam.StructType.fromDDL("name string, other int"), 100, 0)


def test_a_record_inside_of_a_record_is_never_taken_for_one(files, tmp_path):
    """A tag that holds the bytes of five records: a range that begins in it fails, or all rows are right."""
    ranks = {"chr1": 0, "chr2": 1, "chr3": 2}
    inner = b"".join(record(f"inner{i}\t0\tchr1\t{i + 1}\t60\t4M\t*\t0\t0\tACGT\tIIII", ranks) for i in range(40))
    inner += b"\0" * (-len(inner) % 4)
    numbers = ",".join(str(x) for x in struct.unpack(f"<{len(inner) // 4}I", inner))
    lines = HEAD + [f"outer{i}\t0\tchr1\t{i + 1}\t60\t4M\t*\t0\t0\tACGT\tIIII\tXX:B:I,{numbers}" for i in range(6)]
    write_bam(tmp_path / "nested.bam", lines, 500)
    schema, told = bam.StructType.fromDDL("name string"), 0
    for size in (300, 500, 900, 1 << 20):
        reader = bam.BamReader(str(tmp_path / "nested.bam"), schema, size, 0)
        try:
            got = [n for p in reader.partitions() for b in reader.read(p) for n in b["name"].to_pylist()]
            assert got == [f"outer{i}" for i in range(6)]
        except ValueError:
            told += 1
    assert 0 < told < 4  # the whole file in one range is read
