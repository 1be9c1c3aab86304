"""Signals of insertions from reads, as projections and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import sequences as sq
from ..operators import intervals as iv
from ..operators import statistics as st
from ..options import Reading
from ..storage import staged
from . import typing

LEFT, RIGHT = 0, 1


def flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def exclusion(options: Reading) -> Column:
    """Why a read doesn't count: the first reason, or ``kept``. Reads without a mapping quality pass that test."""
    reasons = [(flag(4), "unmapped"), (flag(256), "secondary"), (flag(2048), "supplementary"), (flag(512), "qc_fail")]
    if not options.include_duplicates:
        reasons.append((flag(1024), "duplicate"))
    return sc.first_reason([*reasons, (F.col("mapq") < options.min_mapq, "low_mapq")])


def reads_in(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap a region, each once; placed unmapped reads count with one base."""
    cut = regions.select(F.col("contig").alias("_contig"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    placed = reads.where(F.col("start").isNotNull() & F.col("contig").isNotNull())
    return iv.within_any(placed, cut, [("contig", "_contig")], (F.col("start"), F.col("end")), (F.col("_start"), F.col("_end")))


def _qualities(text: Column) -> Column:
    """Base qualities of a Phred+33 string, in order."""
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)


def lower_median(values: Column, empty: int = 255) -> Column:
    """Middle of an array, the lower of two; ``empty`` for none (and null)."""
    ordered = F.array_sort(values)
    return F.coalesce(F.get(ordered, F.expr("0") + F.floor((F.size(ordered) - 1) / 2).cast("int")), F.lit(empty))


def clips(reads: DataFrame, options: Reading) -> DataFrame:
    """Soft clips long enough at either end, with median quality, tail and side; ``masked`` if all bases are poor."""
    found = sq.soft_clips(F.col("cigar"))
    n = F.length("seq")
    ends = [
        F.struct(F.lit(LEFT).alias("side"), F.col("_c.left").alias("n"), F.col("start").alias("position"), F.substring(F.col("seq"), F.lit(1), F.col("_c.left")).alias("clip"), F.substring(F.col("qual"), F.lit(1), F.col("_c.left")).alias("q")),
        F.struct(F.lit(RIGHT).alias("side"), F.col("_c.right").alias("n"), F.col("end").alias("position"), F.substring(F.col("seq"), n - F.col("_c.right") + 1, F.col("_c.right")).alias("clip"), F.substring(F.col("qual"), n - F.col("_c.right") + 1, F.col("_c.right")).alias("q")),
    ]
    # lengths are tested before any sequence is looked at
    long = reads.withColumn("_c", found).where(F.greatest("_c.left", "_c.right") >= options.overhang)
    rows = long.withColumn("_e", F.explode(F.array(*ends))).where((F.col("_e.n") >= options.overhang) & (F.col("_e.n") <= n))
    values = _qualities(F.col("_e.q"))
    rows = rows.withColumn("median_q", lower_median(values)).withColumn("masked", F.coalesce(F.forall(values, lambda x: x < options.min_clip_quality) & (F.size(values) > 0), F.lit(False)))
    tail = F.when(F.col("_e.side") == LEFT, sq.poly_tail(F.col("_e.clip"), True, options.polya_min_len, options.polya_min_frac)).otherwise(sq.poly_tail(F.col("_e.clip"), False, options.polya_min_len, options.polya_min_frac))
    return rows.select(*_common(F.col("_e.position"), F.col("_e.side"), "soft_clip"), F.col("_e.clip").alias("clip"), "median_q", "masked", tail.alias("tail"), F.col("has_sa").alias("supplementary"), (F.col("_e.n") < options.min_clip_len).alias("short"), F.lit(None).cast("int").alias("mate_contig"), F.lit(None).cast("long").alias("mate_start"), F.lit(None).cast("long").alias("mate_span"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("int").alias("mate_mapq"))


def _common(position: Column, side: Column, kind: str | Column) -> list[Column]:
    return [F.col("contig"), position.cast("long").alias("position"), side.alias("side"), F.col("name").alias("read"), flag(64).alias("first_segment"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), flag(16).alias("reverse"), F.col("start"), F.col("end"), F.col("mapq")]


def mates(reads: DataFrame, options: Reading) -> DataFrame:
    """One row for each paired read that its mate makes a signal, a large-insert candidate or an insert-size sample."""
    proper = flag(2)
    kind = sc.first_reason([
        (flag(8), "mate_unmapped"),
        ((F.col("mq") < options.min_mapq) & ~proper, "mate_low_mapq"),
        (F.col("mate_contig").isNotNull() & (F.col("mate_contig") != F.col("contig")), "mate_elsewhere"),
        (~proper & F.col("mate_contig").isNotNull(), "large_insert"),
        (proper & flag(64) & (F.col("tlen") > 0), "insert_size"),
    ], otherwise="none")
    reverse = flag(16)
    position = F.when(reverse, F.col("start")).otherwise(F.col("end"))
    side = F.when(reverse, F.lit(LEFT)).otherwise(F.lit(RIGHT))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("clip", "string"), ("median_q", "int"), ("masked", "boolean"), ("tail", "struct<base:string,length:int>"), ("supplementary", "boolean"), ("short", "boolean"))]
    rows = reads.where(flag(1)).withColumn("_kind", kind).where("_kind <> 'none'")
    located = F.col("_kind") != "mate_unmapped"
    return rows.select(*_common(position, side, F.col("_kind")), *nothing, F.when(located, F.col("mate_contig")).alias("mate_contig"), F.when(located, F.col("mate_start")).alias("mate_start"), F.when(located, sq.reference_span(F.col("mc"))).alias("mate_span"), F.abs("tlen").alias("length"), F.when(located, F.col("mq")).alias("mate_mapq"))


def insert_sizes(mate_rows: DataFrame, most: int = 10_000) -> DataFrame:
    """One row: n, median, mad and threshold of insert sizes; longer ones than ``most`` count as one more than it."""
    sizes = mate_rows.where("kind = 'insert_size'").select(F.least("length", F.lit(most + 1)).alias("length"))
    return st.outlier_threshold(sizes, [], "length")


def signals(reads: DataFrame, regions: DataFrame, options: Reading, consensus: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals of the reads in the regions, counts of reads by outcome, and the insert-size statistics.

    Large inserts are signals if they exceed the threshold; short clips if they have a tail or
    a hit of some consensus. Rows alike in all columns are one.
    """
    inside = reads_in(reads, regions)
    judged = inside.withColumn("outcome", exclusion(options))
    kept = judged.where("outcome = 'kept'").drop("outcome")
    found = mates(kept, options)
    sizes = insert_sizes(found)
    pairs = found.where("kind not in ('insert_size', 'large_insert')")
    large = found.where("kind = 'large_insert'").crossJoin(F.broadcast(sizes.select("threshold"))).where("length > threshold").drop("threshold")  # one row
    good = clips(kept, options).where(F.col("median_q") >= options.min_clip_quality)
    plain = ~F.col("short") | F.col("tail").isNotNull()
    clipped = good.where(plain)
    if consensus is not None:
        short = staged(good.where(~plain), "short-clips")
        known = typing.hits(short.select(F.upper("clip").alias("id"), F.upper("clip").alias("seq")).distinct(), consensus).select(F.col("id").alias("_clip")).distinct()
        clipped = clipped.unionByName(short.join(known, F.upper("clip") == F.col("_clip"), "left_semi"))
    both = clipped.unionByName(pairs).unionByName(large)
    return both.dropDuplicates(), judged.groupBy("outcome").agg(F.count("*").alias("n")), sizes
