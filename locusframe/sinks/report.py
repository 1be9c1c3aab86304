"""Reports of candidates as TSV, BED, JSON and VCF lines.

Lines are built as columns; the order is that of the clusters, and ids number the rows that
are left. Files are written by Spark, or as one file by the driver, which takes the lines
one partition after the other.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators.positions import ranked
from ..plans.candidates import KEYS, with_later

NOTICE = "For research use only: no validated test. A call is a candidate to be confirmed; the absence of a call excludes nothing."
POSITIONS = "1-based; a position p means that the insertion is right after base p"

# Fixed values of the formats: columns of the table, and declarations of the VCF.
TSV_COLUMNS = [
    "id", "contig", "position", "left_junction", "right_junction", "tsd_length", "strand", "filter", "confidence", "support",
    "left_clips", "right_clips", "left_junction_clips", "right_junction_clips", "short_junction_clips", "unmapped_mates", "discordant_mates", "polya_clips", "polyt_clips", "both_sides",
    "distinct_starts", "depth", "signal_ratio", "start", "end", "family", "subfamily", "element_strand", "element_start", "element_end",
    "identity", "typed_clips", "short_typed_clips", "checked_mates", "mei_mates", "assembled", "tsd", "polya_length", "qual", "genotype",
    "gq", "alt_reads", "ref_reads", "typed_by", "cipos", "breakpoint_clips",
]
ALT = {"INS:ME:ALU": "Alu element", "INS:ME:LINE1": "LINE-1 element", "INS:ME:SVA": "SVA element", "INS:ME": "Mobile element of unknown family"}
FILTERS = {
    "no_junction": "Too few soft clips at the junctions",
    "no_tail": "No soft clip with a tail",
    "untyped": "Too few junction clips of an element",
    "non_mei_mates": "Too few mates of an element among those looked at",
    "tandem_repeat": "Soft clips explained by a longer tract of the reference",
    "probe_edge": "Soft clips at a probe's edge without tail, typed clip or duplicated site",
    "low_ratio": "Too few supporting reads for the depth",
    "low_qual": "Quality below the minimum",
}
INFO = {
    "SVTYPE": ("1", "String", "Type of variant"),
    "SVLEN": ("1", "Integer", "Length of the consensus that reads cover"),
    "MEINFO": ("4", "String", "Subfamily, start and end on its consensus, strand"),
    "IMPRECISE": ("0", "Flag", "No junction is assembled"),
    "CIPOS": ("2", "Integer", "Interval around POS of an insertion that mates place"),
    "BREAKPOINT_CLIPS": ("1", "Integer", "Reads clipped by a few bases at POS"),
    "LEFT_JUNCTION": ("1", "Integer", "End of the flank before the insertion"),
    "RIGHT_JUNCTION": ("1", "Integer", "Base before the flank after the insertion"),
    "TSD": ("1", "String", "Duplicated site of the assembled junctions"),
    "TSD_LEN": ("1", "Integer", "Length of the duplicated site"),
    "POLYA_LEN": ("1", "Integer", "Length of the tail of an assembled junction"),
    "ASSEMBLED": ("1", "String", "Junctions assembled: both, left, right or none"),
    "CONFIDENCE": ("1", "String", "high (tail and duplicated site), medium (tail) or low"),
    "SUPPORT": ("1", "Integer", "Distinct supporting reads"),
    "JUNCTION_CLIPS": ("2", "Integer", "Soft clips at the left and right junction"),
    "TAIL_CLIPS": ("2", "Integer", "Soft clips with a tail of A and of T"),
    "TYPED_CLIPS": ("1", "Integer", "Junction clips of the family"),
    "TYPED_BY": ("1", "String", "clips or mates"),
    "MATES": ("2", "Integer", "Reads with an unmapped and with a discordant mate"),
    "MEI_MATES": ("2", "Integer", "Mates looked at, and those of the family"),
    "DISTINCT_STARTS": ("1", "Integer", "Distinct starts of supporting reads"),
    "SIGNAL_RATIO": ("1", "Float", "Supporting reads by depth"),
}
FORMAT = {"GT": ("1", "String", "Genotype"), "GQ": ("1", "Integer", "Genotype quality"), "AD": ("R", "Integer", "Reads of the reference and of the insertion"), "DP": ("1", "Integer", "Reads counted")}


@dataclass(frozen=True)
class Heading:
    """What a report says of itself. The command is given without folders."""

    sample: str
    command: str = ""
    contigs: tuple[tuple[str, int], ...] = ()
    reference: str | None = None


def command_line(arguments: Iterable[str]) -> str:
    """Arguments as one line, with paths reduced to their last part."""
    return " ".join(os.path.basename(a.rstrip("/")) if "/" in a else a for a in arguments)


def numbered(candidates: DataFrame) -> DataFrame:
    """Add ``number`` and ``id`` by the order of contig rank and cluster."""
    rows = ranked(candidates, [], ["contig", "cluster_start"], "_rank")
    number = (F.col("_rank") + 1).cast("long")
    return rows.withColumn("number", number).withColumn("id", F.concat(F.lit("MEI_"), number)).drop("_rank")


def _complete(candidates: DataFrame) -> DataFrame:
    """Numbered candidates with every column of a report; null where a step didn't run."""
    rows = with_later(candidates)
    for name, kind in {"assembled": "string", "tsd_bases": "string", "tail_run": "int", "ref_base": "string", "left_contig": "string", "left_insert": "string", "right_contig": "string", "right_insert": "string", "tail_base": "string"}.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return numbered(rows)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))


def _ratio(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.3f", sc.round3(c)))


def _filter() -> Column:
    return F.when(F.size("filters") == 0, F.lit("PASS")).otherwise(F.array_join("filters", ";"))


def _strand(reverse: Column) -> Column:
    return F.when(reverse, F.lit("-")).otherwise(F.lit("+"))


def _values() -> dict[str, Column]:
    """The columns of a report that aren't columns of a candidate of the same name."""
    typed = F.col("family").isNotNull()
    called = F.col("genotype").isNotNull()
    return {
        "contig": F.col("contig_name"),
        "position": F.col("breakpoint"),
        "tsd_length": F.col("tsd"),
        "strand": F.when(F.col("polya_clips") > F.col("polyt_clips"), F.lit("+")).when(F.col("polya_clips") < F.col("polyt_clips"), F.lit("-")).otherwise(F.lit(".")),
        "left_clips": F.col("left_side_clips"),
        "right_clips": F.col("right_side_clips"),
        "left_junction_clips": F.col("left_clips"),
        "right_junction_clips": F.col("right_clips"),
        "element_strand": F.when(typed, _strand(F.col("reverse"))),
        "element_start": F.col("element_start") + 1,
        "tsd": F.col("tsd_bases"),
        "polya_length": F.col("tail_run"),
        "genotype": F.col("genotype.call"),
        "gq": F.col("genotype.quality"),
        "alt_reads": F.when(called, F.col("alt_reads")),
        "ref_reads": F.when(called, F.col("ref_reads")),
        "typed_by": F.when(typed, F.when(F.col("by_mates"), F.lit("mates")).otherwise(F.lit("clips"))),
        "cipos_first": F.col("mate_first") - F.col("breakpoint"),
        "cipos_last": F.col("mate_last") - F.col("breakpoint"),
    }


def tsv(candidates: DataFrame) -> DataFrame:
    """number and line for each candidate; a point stands for what is missing."""
    values = _values()
    values |= {
        "filter": _filter(),
        "both_sides": F.when(F.col("both_sides"), F.lit("yes")).otherwise(F.lit("no")),
        "signal_ratio": _ratio(F.col("signal_ratio")),
        "identity": _ratio(F.col("identity")),
        "cipos": F.concat(values["cipos_first"].cast("string"), F.lit(","), values["cipos_last"].cast("string")),
    }
    return _complete(candidates).select("number", F.concat_ws("\t", *[_text(values.get(c, F.col(c) if c not in values else F.lit(None))) for c in TSV_COLUMNS]).alias("line"))


def bed(candidates: DataFrame) -> DataFrame:
    """The duplicated site if it is known, else the base before the breakpoint; score by support, capped at 1000."""
    known = F.col("tsd").isNotNull() & F.col("right_junction").isNotNull()
    start = F.when(known, F.col("right_junction")).otherwise(F.greatest(F.col("breakpoint") - 1, F.lit(0)))
    end = F.when(known, F.col("right_junction") + F.col("tsd")).otherwise(F.greatest(F.col("breakpoint"), F.lit(1)))
    label = F.when(F.size("filters") == 0, _text(F.col("confidence"))).otherwise(_filter())
    return _complete(candidates).select("number", F.concat_ws("\t", "contig_name", start.cast("string"), end.cast("string"), "id", F.least("support", F.lit(1000)).cast("string"), _values()["strand"], label).alias("line"))


def vcf_info() -> Column:
    """The INFO field of a candidate."""
    v = _values()
    both = lambda name, a, b: F.concat(F.lit(f"{name}="), a.cast("string"), F.lit(","), b.cast("string"))
    one = lambda name, a: F.concat(F.lit(f"{name}="), a.cast("string"))
    typed = F.col("family").isNotNull()
    return F.concat_ws(
        ";",
        F.lit("SVTYPE=INS"),
        F.when(typed, one("SVLEN", F.col("element_end") - F.col("element_start"))),
        F.when(typed, F.concat(F.lit("MEINFO="), F.concat_ws(",", "subfamily", v["element_start"].cast("string"), F.col("element_end").cast("string"), v["element_strand"]))),
        F.when(F.coalesce("assembled", F.lit("none")) == "none", F.lit("IMPRECISE")),
        both("CIPOS", v["cipos_first"], v["cipos_last"]),
        F.when(F.col("breakpoint_clips") > 0, one("BREAKPOINT_CLIPS", F.col("breakpoint_clips"))),
        one("LEFT_JUNCTION", F.col("left_junction")),
        one("RIGHT_JUNCTION", F.col("right_junction")),
        one("TSD", F.col("tsd_bases")),
        one("TSD_LEN", F.col("tsd")),
        one("POLYA_LEN", F.col("tail_run")),
        one("ASSEMBLED", F.col("assembled")),
        F.when(F.size("filters") == 0, one("CONFIDENCE", F.col("confidence"))),
        one("TYPED_BY", v["typed_by"]),
        one("SUPPORT", F.col("support")),
        both("JUNCTION_CLIPS", F.col("left_clips"), F.col("right_clips")),
        both("TAIL_CLIPS", F.col("polya_clips"), F.col("polyt_clips")),
        one("TYPED_CLIPS", F.coalesce("typed_clips", F.lit(0))),
        both("MATES", F.col("unmapped_mates"), F.col("discordant_mates")),
        both("MEI_MATES", F.col("checked_mates"), F.col("mei_mates")),
        one("DISTINCT_STARTS", F.col("distinct_starts")),
        F.when(F.col("signal_ratio").isNotNull(), one("SIGNAL_RATIO", _ratio(F.col("signal_ratio")))),
    )


def vcf_sample() -> Column:
    """Genotype, its quality, reads of both alleles (the reference's once for a site) and their sum."""
    refs = F.floor(F.col("ref_reads") / F.greatest("junctions", F.lit(1))).cast("long")
    told = F.concat_ws(":", "genotype.call", F.col("genotype.quality").cast("string"), F.concat_ws(",", refs.cast("string"), F.col("alt_reads").cast("string")), (refs + F.col("alt_reads")).cast("string"))
    return F.when(F.col("genotype").isNull(), F.lit("./.:.:.:.")).otherwise(told)


def vcf(candidates: DataFrame) -> DataFrame:
    """Records with a symbolic allele; REF is N where the reference's base isn't known."""
    alt = F.when(F.col("family").isNull(), F.lit("<INS:ME>")).otherwise(F.concat(F.lit("<INS:ME:"), "family", F.lit(">")))
    columns = ["contig_name", F.greatest(F.col("breakpoint"), F.lit(1)).cast("string"), "id", F.coalesce("ref_base", F.lit("N")), alt, _text(F.col("qual")), _filter(), vcf_info(), F.lit("GT:GQ:AD:DP"), vcf_sample()]
    return _complete(candidates).select("number", F.concat_ws("\t", *columns).alias("line"))


_SIGNAL_ORDER = ["position", "side", "read", "first_segment", "kind", "start", "end"]


def anonymous(signals: DataFrame, order: list[str]) -> DataFrame:
    """Read names as read_1, read_2, ... by first appearance in the order."""
    first = signals.groupBy("read").agg(F.min(F.struct(*order)).alias("_at"))
    named = ranked(first, [], ["_at", "read"], "_rank").select(F.col("read").alias("_read"), F.concat(F.lit("read_"), F.col("_rank") + 1).alias("_name"))
    return signals.join(named, F.col("read") == F.col("_read")).withColumn("read", F.col("_name")).drop("_read", "_name")


def nested_signals(signals: DataFrame, contigs: DataFrame, anonymize: bool = False) -> DataFrame:
    """KEYS and a JSON array of each candidate's signals in their order; fields that a kind lacks are left out."""
    rows = signals.withColumn("_real", F.col("read"))
    rows = anonymous(rows, [*KEYS, *_SIGNAL_ORDER]) if anonymize else rows
    named = F.broadcast(contigs.select(F.col("rank").alias("_rank"), F.col("name").alias("mate_name")))  # header rows
    rows = rows.join(named, F.col("mate_contig") == F.col("_rank"), "left")
    clip = F.col("kind") == "soft_clip"
    fields = [
        F.col("kind"),
        "position",
        F.when(F.col("side") == 0, F.lit("left")).otherwise(F.lit("right")).alias("side"),
        "read",
        F.when(F.col("first_segment"), F.lit(1)).otherwise(F.lit(2)).alias("segment"),
        _strand(F.col("reverse")).alias("strand"),
        (F.col("start") + 1).alias("read_start"),
        F.col("end").alias("read_end"),
        "mapq",
        F.when(clip, F.col("clip")).alias("clipped_sequence"),
        F.when(clip, F.col("median_q")).alias("median_quality"),
        F.when(clip, F.concat(F.col("tail.base"), F.col("tail.length").cast("string"))).alias("tail"),
        F.when(clip, F.col("supplementary")).alias("supplementary"),
        F.when(clip, F.col("short")).alias("short"),
        F.when(F.col("kind") == "mate_low_mapq", F.col("mate_mapq")).alias("mate_mapq") if "mate_mapq" in rows.columns else F.lit(None).cast("int").alias("mate_mapq"),
        F.when(F.col("kind") == "mate_elsewhere", F.col("mate_name")).alias("mate_contig"),
        F.when(F.col("kind") == "large_insert", F.col("length")).alias("insert_length"),
        (F.col("mei") if "mei" in rows.columns else F.lit(None).cast("boolean")).alias("mei_mate"),
    ]
    # mapq is null where a read has none, and stays; what is null for its kind goes
    one = F.regexp_replace(F.to_json(F.struct(*fields)), r'("read_end":[0-9]++)(?!,"mapq")', '$1,"mapq":null')
    placed = rows.select(*KEYS, F.struct(*["_real" if c == "read" else c for c in _SIGNAL_ORDER], one.alias("json")).alias("s"))
    return placed.groupBy(*KEYS).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["json"]), ","), F.lit("]")).alias("signals"))


def json(candidates: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """One JSON object for each candidate; filters are a list, absent values are null.

    signals: nested_signals of the scan; the assembly is left out where none was tried.
    """
    v = _values()
    rows = _complete(candidates)
    order = [c for c in TSV_COLUMNS if c not in ("assembled", "tsd", "polya_length", "cipos", "filter")]
    special = {"signal_ratio": sc.round3(F.col("signal_ratio")), "identity": sc.round3(F.col("identity")), "typed_clips": F.coalesce("typed_clips", F.lit(0)), "short_typed_clips": F.coalesce("short_typed_clips", F.lit(0))}
    fields = [(special.get(c) if c in special else v.get(c, F.col(c) if c not in v else None)).alias(c) for c in order]
    passed = F.when(F.size("filters") == 0, F.array(F.lit("PASS"))).otherwise(F.col("filters"))
    fields += [passed.alias("filter"), F.when(F.col("mate_first").isNotNull(), F.array(v["cipos_first"], v["cipos_last"])).alias("cipos")]
    side = lambda k: F.when(F.col(f"{k}_contig").isNotNull(), F.struct(F.col(f"{k}_junction").alias("junction"), F.col(f"{k}_contig").alias("contig"), F.col(f"{k}_insert").alias("inserted"))).alias(k)
    built = F.to_json(F.struct("assembled", side("left"), side("right"), F.col("tsd_bases").alias("tsd"), F.col("tail_run").alias("polya_length"), "tail_base"), {"ignoreNullFields": "false"})
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    extra = F.when(F.col("assembled").isNotNull(), F.concat(F.lit(',"assembly":'), built)).otherwise(F.lit(""))
    if signals is not None:
        rows = rows.join(signals, KEYS, "left")
        extra = F.concat(extra, F.lit(',"signals":'), F.coalesce("signals", F.lit("[]")))
    return rows.select("number", F.concat(F.regexp_replace(body, r"\}$", ""), extra, F.lit("}")).alias("line"))


def tsv_header(heading: Heading) -> list[str]:
    return ["##locusframe", f"##note: {NOTICE}", f"##command: {heading.command}", f"##sample: {heading.sample}", f"##positions: {POSITIONS}", "#" + "\t".join(TSV_COLUMNS)]


def bed_header(heading: Heading) -> list[str]:
    return [f"# locusframe: {NOTICE}"]


def vcf_header(heading: Heading) -> list[str]:
    """Declarations and the column line of VCF 4.2."""
    lines = ["##fileformat=VCFv4.2", "##source=locusframe", f"##command={heading.command}", f"##note={NOTICE}"]
    lines += [f"##reference={heading.reference}"] if heading.reference else []
    lines += [f"##contig=<ID={name},length={length}>" for name, length in heading.contigs]
    lines += [f'##ALT=<ID={k},Description="{d}">' for k, d in ALT.items()]
    lines += [f'##FILTER=<ID={k},Description="{d}">' for k, d in {"PASS": "All filters passed", **FILTERS}.items()]
    for kind, fields in (("INFO", INFO), ("FORMAT", FORMAT)):
        lines += [f'##{kind}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in fields.items()]
    return [*lines, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", heading.sample])]


def _json_frame(heading: Heading) -> tuple[list[str], str, list[str]]:
    """Lines before the candidates, what parts them, and lines after."""
    import json as js

    head = js.dumps({"locusframe": 1, "note": NOTICE, "command": heading.command, "sample": heading.sample, "positions": POSITIONS})
    return [head[:-1] + ', "candidates": ['], ",", ["]}"]


def write(candidates: DataFrame, path: str, form: str, heading: Heading, signals: DataFrame | None = None) -> int:
    """Write the report in one of the formats tsv, bed, json and vcf as one local file; returns how many candidates it has."""
    if form == "json":
        before, between, after = _json_frame(heading)
        return write_one(json(candidates, signals), path, before, between, after)
    makers = {"tsv": (tsv, tsv_header), "bed": (bed, bed_header), "vcf": (vcf, vcf_header)}
    if form not in makers:
        raise ValueError(f"{form}: the formats are tsv, bed, json and vcf")
    lines, header = makers[form]
    return write_one(lines(candidates), path, header(heading))


def write_one(lines: DataFrame, path: str, header: Iterable[str] = (), between: str = "", footer: Iterable[str] = ()) -> int:
    """Write header, lines and footer as one local file (gzip by its ending), in place only when it is whole."""
    part = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{os.getpid()}.part")
    opened = gzip.open(part, "wt", encoding="utf-8") if path.endswith(".gz") else open(part, "w", encoding="utf-8")
    n = 0

    def ordered() -> Iterator[str]:
        nonlocal n
        for row in lines.orderBy("number").toLocalIterator():
            yield (between + "\n" if n and between else "") + row["line"] + ("" if between else "\n")
            n += 1

    try:
        with opened as out:
            out.writelines(f"{h}\n" for h in header)
            out.writelines(ordered())
            out.writelines(f"\n{f}" if between else f"{f}\n" for f in footer)
            if between:
                out.write("\n")
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    return n
