"""Tables from text formats: SAM, BED, FASTA, GTF, chain files, truth and call tables.

All are read with Spark's text and CSV readers, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _place() -> list[Column]:
    """Where a line lies: file, first byte of the piece of the file that a task reads, and a number that grows inside the piece."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]


def _tag(name: str, kind: str) -> Column:
    """Value of a SAM tag; null if the read has none."""
    found = F.regexp_extract(F.col("value"), f"\t{name}:{kind}:([^\t]*)", 1)
    return F.when(found != "", found)


def sam_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """contigs (rank, name, length, m5) in the header's order, and samples (sample, rank).

    Only the first lines of the file are read: as many as begin with @.
    """
    n, lines = 10_000, []
    while True:
        lines = [r["value"] for r in spark.read.text(path).limit(n).collect()]  # a header, and few lines more
        if len(lines) < n or not all(x.startswith("@") for x in lines):
            break
        n *= 10
    return header_tables(spark, lines)


def header_tables(spark: SparkSession, lines: list[str]) -> tuple[DataFrame, DataFrame]:
    """contigs and samples of header lines; lines that don't begin with @ are left out."""
    fields = [(x[:3], dict(f.split(":", 1) for f in x.split("\t")[1:] if ":" in f)) for x in lines if x.startswith("@")]
    found = [f for kind, f in fields if kind == "@SQ"]
    contigs = [(i, f.get("SN"), int(f["LN"]) if "LN" in f else None, f["M5"].lower() if "M5" in f else None) for i, f in enumerate(found)]
    names = dict.fromkeys(f["SM"] for kind, f in fields if kind == "@RG" and "SM" in f)
    return spark.createDataFrame(contigs, "rank int, name string, length long, m5 string"), spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample string, rank int")


def sample_name(samples: DataFrame, stem: str) -> tuple[str, str | None]:
    """The only sample, else the first or the file's stem, with a warning."""
    names = [r["sample"] for r in samples.orderBy("rank").limit(2).collect()]
    if not names:
        return stem, "no sample is named; the file's name stands for it"
    return names[0], "several samples are named; the first counts" if len(names) > 1 else None


def sam_reads(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """One row for each read, positions 0-based half-open; contig is the contig's rank, and ``at`` grows in the file's order."""
    from ..functions.sequences import reference_span

    lines = spark.read.text(path).select("value", F.struct(*_place()).alias("at")).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    # header lines may meet these expressions before they are left out, so none of them may fail
    at = lambda i: F.get(f, F.lit(i))
    known = F.broadcast(contigs.select(F.col("rank").alias("contig"), F.col("name").alias("contig_name")))  # header rows
    mate = F.broadcast(contigs.select(F.col("rank").alias("mate_contig"), F.col("name").alias("mate_name")))
    start = at(3).try_cast("long") - 1
    given = lambda i: F.when(at(i) != "*", at(i))
    mapq = at(4).try_cast("int")
    rows = lines.select(
        at(0).alias("name"),
        at(1).try_cast("int").alias("flag"),
        at(2).alias("rname"),
        F.when(start >= 0, start).alias("start"),
        F.when(mapq != 255, mapq).alias("mapq"),
        given(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("rnext"),
        F.when(at(7).try_cast("long") > 0, at(7).try_cast("long") - 1).alias("mate_start"),
        at(8).try_cast("long").alias("tlen"),
        given(9).alias("seq"),
        given(10).alias("qual"),
        _tag("MQ", "i").try_cast("int").alias("mq"),
        _tag("MC", "Z").alias("mc"),
        _tag("SA", "Z").isNotNull().alias("has_sa"),
        "at",
    )
    placed = rows.join(known, F.col("rname") == F.col("contig_name"), "left").join(mate, F.col("rnext") == F.col("mate_name"), "left")
    span = F.coalesce(reference_span(F.col("cigar")), F.lit(1))
    return placed.withColumn("end", F.col("start") + span).drop("rname", "rnext", "mate_name")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, name, line (from 1) and error. Skips empty lines, comments, track and browser lines.

    Lines that are not of the format have a reason in ``error``; see checked_bed. Targets are a
    small file, which one task reads; it is unpacked by its first bytes, whatever its name.
    """
    raw = spark.read.format("binaryFile").load(path)
    packed = any(r["m"] == b"\x1f\x8b" for r in raw.select(F.substring("content", 1, 2).alias("m")).collect())
    if packed and not path.endswith(".gz"):
        content = b"".join(gzip.decompress(bytes(r["content"])) for r in raw.collect()).decode()
        lines = spark.createDataFrame([(x, i + 1) for i, x in enumerate(content.split("\n"))], "value string, line long")
    else:
        lines = spark.read.text(path).coalesce(1).select("value", (F.monotonically_increasing_id() + 1).alias("line"))
    kept = lines.withColumn("value", F.trim("value")).where((F.col("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    f = F.split("value", r"\s+")
    whole = lambda i: F.get(f, F.lit(i)).rlike("^[0-9]+$")
    parsed = kept.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"), "value", "line", F.size(f).alias("n"), (whole(1) & whole(2)).alias("digits"))
    error = F.when(F.col("n") < 3, F.concat(F.lit("fewer than three columns: "), "value")).when(~F.col("digits"), F.concat(F.lit("not a position: "), "value")).when(F.col("end") <= F.col("start"), F.concat(F.lit("ends before it begins: "), "value"))
    return parsed.select("contig", "start", "end", "name", "line", error.alias("error"))


def checked_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end and name of a BED file; an error names the first line that isn't of the format, or an empty file."""
    rows = bed(spark, path)
    bad = rows.where("error is not null").orderBy("line").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0]['line']}: {bad[0]['error']}")
    if not rows.limit(1).count():
        raise ValueError(f"{path}: no target")
    return rows.select("contig", "start", "end", "name")


def _records(spark: SparkSession, path: str, is_head: Column, head: Column, amounts: dict[str, Column]) -> DataFrame:
    """The lines of a file's records, cut by bytes as Spark likes: value, file, record, head, and what the lines since the head add up to.

    A record is a line for which is_head holds and those that follow. Each piece of a file sums up its own lines, and
    learns from a small table, with a row for each piece, under which head it begins and what came before.
    """
    raw = spark.read.text(path).select("value", *_place())
    added = raw.withColumn("is_head", is_head).withColumns({f"own_{c}": F.when(F.col("is_head"), F.lit(0)).otherwise(F.coalesce(v, F.lit(0))).cast("long") for c, v in amounts.items()})
    piece = Window.partitionBy("file", "block").orderBy("line")
    before = piece.rowsBetween(Window.unboundedPreceding, -1)
    summed = added.withColumns({f"in_{c}": F.coalesce(F.sum(f"own_{c}").over(before), F.lit(0)) for c in amounts})
    opened = summed.withColumn("opened", F.when(F.col("is_head"), F.struct("block", "line", *[F.col(f"in_{c}") for c in amounts], head.alias("head"))))
    within = opened.withColumn("last", F.last("opened", ignorenulls=True).over(piece.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = opened.groupBy("file", "block").agg(F.max("opened").alias("last"), *[F.sum(f"own_{c}").alias(f"all_{c}") for c in amounts])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.withColumns({f"to_{c}": F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)) for c in amounts})
    heads = totals.withColumn("open", F.when(F.col("last").isNotNull(), F.struct("last", *[(F.col(f"to_{c}") + F.col(f"last.in_{c}")).alias(f"at_{c}") for c in amounts])))
    known = heads.select(F.col("file").alias("_file"), F.col("block").alias("_block"), *[F.col(f"to_{c}") for c in amounts], F.last("open", ignorenulls=True).over(earlier).alias("open"))
    joined = within.join(known, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    own = F.col("last").isNotNull()
    since = {c: F.when(own, F.col(f"in_{c}") - F.col(f"last.in_{c}")).otherwise(F.col(f"to_{c}") + F.col(f"in_{c}") - F.col(f"open.at_{c}")) for c in amounts}
    first = F.coalesce("last", "open.last")
    return joined.where(~F.col("is_head") & first.isNotNull()).select("value", "file", F.struct(first["block"].alias("block"), first["line"].alias("line")).alias("record"), first["head"].alias("head"), *[v.alias(c) for c, v in since.items()])


def fasta(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """Sequences in upper case as chunks: contig, chunk (from 0), seq.

    The file is read line by line in as many pieces as Spark likes: a line learns where in its contig it lies, is
    cut at chunk ends, and chunks are put together. No row holds more than a line or a chunk.
    """
    seq = F.upper(F.regexp_replace("value", r"\s+", ""))
    lines = _records(spark, path, F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1), {"at": F.length(seq)})
    placed = lines.select("file", "record", F.col("head").alias("contig"), "at", seq.alias("bases")).where("bases <> ''")
    cut = placed.withColumn("chunk", F.explode(F.expr(f"sequence(at div {chunk}, (at + length(bases) - 1) div {chunk})")))
    low = F.greatest(F.col("chunk") * chunk, F.col("at"))
    high = F.least((F.col("chunk") + 1) * chunk, F.col("at") + F.length("bases"))
    part = F.substring(F.col("bases"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    pieces = cut.select("file", "record", "contig", "chunk", F.struct(low.alias("at"), part.alias("part")).alias("piece"))
    whole = pieces.groupBy("file", "record", "contig", "chunk").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select("contig", "chunk", F.array_join(F.transform("pieces", lambda x: x["part"]), "").alias("seq"))


def bases(rows: DataFrame, reference: DataFrame, contig: str, start: Column, end: Column, name: str = "window", chunk: int = 10_000) -> DataFrame:
    """Add the reference bases of each row's window (cut at the contig's ends; null if there are none).

    The rows must be distinct.
    """
    low, high = F.greatest(start, F.lit(0)), end
    need = rows.withColumn("_low", low).withColumn("_high", high).where("_high > _low").withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_low") / chunk), F.floor((F.col("_high") - 1) / chunk))))
    ref = reference.select(F.col("contig").alias("_rc"), F.col("chunk").alias("_rchunk"), F.col("seq").alias("_rs"))
    origin = F.col("_chunk") * chunk
    part = F.substring(F.col("_rs"), (F.greatest(F.col("_low") - origin, F.lit(0)) + 1).cast("int"), (F.least(F.col("_high") - origin, F.lit(chunk)) - F.greatest(F.col("_low") - origin, F.lit(0))).cast("int"))
    hits = need.join(ref, (F.col(contig) == F.col("_rc")) & (F.col("_chunk") == F.col("_rchunk"))).select(*rows.columns, "_chunk", part.alias("_part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))), lambda x: x["_part"]), "")
    windows = hits.groupBy(*rows.columns).agg(F.nullif(joined, F.lit("")).alias(name))
    match = None
    for c in rows.columns:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        match = same if match is None else match & same
    return rows.alias("a").join(windows.alias("b"), match, "left").select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], F.col(f"b.{name}").alias(name))


def consensus(spark: SparkSession, path: str) -> DataFrame:
    """cid (in file order), name, family and seq of element consensus sequences.

    The family comes from the class after ``#`` (its last part), or from the name where there is
    none; other families and empty sequences are left out.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0).select("value", F.monotonically_increasing_id().alias("at"))
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    name, kind = F.substring_index(head, "#", 1), F.when(head.contains("#"), F.lower(F.substring_index(head, "#", -1)))
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"[^A-Za-z]+", ""))
    low = F.lower(name)
    family = F.when(kind.endswith("/alu") | (kind.isNull() & low.startswith("alu")), "ALU").when(kind.endswith("/l1") | (kind.isNull() & low.startswith("l1")), "LINE1").when(kind.endswith("/sva") | (kind.isNull() & low.startswith("sva")), "SVA")
    rows = records.select("at", name.alias("name"), family.alias("family"), seq.alias("seq")).where("family is not null and seq <> ''")
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("cid"), "name", "family", "seq")


def gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon", "CDS")) -> DataFrame:
    """contig, feature, start, end of the features, as 0-based half-open intervals."""
    rows = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    return rows.where(F.col("_c2").isin(*features)).select(F.col("_c0").alias("contig"), F.col("_c2").alias("feature"), (F.col("_c3").cast("long") - 1).alias("start"), F.col("_c4").cast("long").alias("end"))


def merged_features(spark: SparkSession, path: str) -> DataFrame:
    """contig (without chr), feature, start, end: exons and coding sequences, those that overlap or touch as one."""
    from ..operators.intervals import merge_intervals

    rows = gtf(spark, path).select(plain_contig(F.col("contig")).alias("contig"), "feature", "start", "end")
    return merge_intervals(rows, ["contig", "feature"]).select("contig", "feature", "start", "end")


def chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a chain file: source, s, e, score, chain, q_contig, q_size, strand, q_start.

    The file is read line by line; a block begins where the sizes and gaps of those before it in its chain end.
    """
    number = lambda i: F.get(F.split(F.trim("value"), r"\s+"), F.lit(i)).try_cast("long")
    lines = _records(spark, path, F.col("value").startswith("chain "), F.split(F.trim("value"), r"\s+"), {"t": number(0) + F.coalesce(number(1), F.lit(0)), "q": number(0) + F.coalesce(number(2), F.lit(0))})
    h = lambda i: F.get("head", F.lit(i))
    start = h(5).cast("long") + F.col("t")
    blocks = lines.where(F.trim("value").rlike("^[0-9]"))
    return blocks.select(h(2).alias("source"), start.alias("s"), (start + number(0)).alias("e"), h(1).cast("long").alias("score"), h(12).cast("long").alias("chain"), h(7).alias("q_contig"), h(8).cast("long").alias("q_size"), h(9).alias("strand"), (h(10).cast("long") + F.col("q")).alias("q_start"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Long form of a wide truth table: id, contig, pos, family, sample, genotype; absent genotypes are left out.

    Samples are the columns between FORMAT and Caller_Count.
    """
    rows = spark.read.option("header", True).csv(path)
    names = rows.columns[rows.columns.index("FORMAT") + 1 : rows.columns.index("Caller_Count")]
    tall = rows.unpivot(["ID", "CHROM", "POS", "TE_Designation"], names, "sample", "genotype")
    return tall.select(F.col("ID").alias("id"), plain_contig(F.col("CHROM")).alias("contig"), F.col("POS").cast("long").alias("pos"), F.col("TE_Designation").alias("family"), "sample", "genotype").where("genotype is not null")


def plain_contig(name: Column) -> Column:
    """A contig's name without the prefix chr, so that both styles compare; M is MT."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def calls_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a VCF: contig, pos, id, filter, and the fields of INFO as a map (flags have null)."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    return lines.select(plain_contig(at(0)).alias("contig"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(4).alias("alt"), F.nullif(at(5), F.lit(".")).try_cast("int").alias("qual"), at(6).alias("filter"), F.str_to_map(at(7), F.lit(";"), F.lit("=")).alias("info"))


def calls_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a table with ## lines and a # header; a point is null. All columns are strings."""
    lines = spark.read.text(path).where(~F.col("value").startswith("##") & (F.col("value") != ""))
    header = lines.where(F.col("value").startswith("#")).first()
    if header is None:
        raise ValueError(f"{path}: the header is missing")
    names = header["value"].lstrip("#").split("\t")
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("#")).select(*[F.nullif(F.get(f, F.lit(i)), F.lit(".")).alias(n) for i, n in enumerate(names)])
