"""Candidates from signals: clusters, their profile, depth, filters, scores and genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import intervals as iv
from ..operators import positions as po
from ..operators import statistics as st
from ..options import Calling, Reading
from .extract import LEFT, RIGHT, exclusion

KEYS = ["contig", "cluster_start"]
NEAR_JUNCTION = 2
LONGEST_TSD = 50
MATE_NEAR, MATE_FAR = 20, 300
ALLELE_SLACK = 5


def clustered(signals: DataFrame, window: int) -> DataFrame:
    return po.gap_clusters(signals, ["contig"], "position", window, ["side", "read", "kind"])


def profiles(rows: DataFrame, options: Calling) -> DataFrame:
    """One row for each cluster: counts, junctions, target site duplication, breakpoint, and the filters known so far.

    A histogram with a row for each position of a cluster tells the junctions (modes), what lies near them, and where
    the mates place the breakpoint; only what it can't tell is aggregated from the signals themselves.
    """
    clip = F.col("kind") == "soft_clip"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sides = (("left", RIGHT), ("right", LEFT))  # clips on a read's right lie at the left junction
    by_position = rows.groupBy(*KEYS, "position").agg(
        *[count(clip & (F.col("side") == side)).alias(f"n_{name}") for name, side in sides],
        *[count(clip & (F.col("side") == side) & F.col("short")).alias(f"short_{name}") for name, side in sides],
        count(~clip & (F.col("side") == RIGHT)).alias("mates_up"),
        count(~clip & (F.col("side") != RIGHT)).alias("mates_down"),
    )
    n_clips = F.col("n_left") + F.col("n_right")
    mode = lambda n: F.min(F.when(n > 0, F.struct(-n, F.col("position").alias("position"))))["position"]
    shaped = by_position.groupBy(*KEYS).agg(
        mode(F.col("n_left")).alias("left_junction"),
        mode(F.col("n_right")).alias("right_junction"),
        mode(n_clips).alias("clip_mode"),
        F.max(F.when(F.col("mates_up") > 0, F.col("position"))).alias("up"),
        F.min(F.when(F.col("mates_down") > 0, F.col("position"))).alias("down"),
        F.sum("mates_up").alias("n_up"),
        F.sum("mates_down").alias("n_down"),
    )
    near = {name: F.coalesce(F.abs(F.col("position") - F.col(f"{name}_junction")) <= NEAR_JUNCTION, F.lit(False)) for name, _ in sides}
    close = lambda what, name: F.when(near[name], F.col(f"{what}_{name}")).otherwise(F.lit(0))
    beside = by_position.join(shaped.select(*KEYS, "left_junction", "right_junction"), KEYS).groupBy(*KEYS).agg(
        F.sum(close("n", "left")).alias("left_clips"), F.sum(close("n", "right")).alias("right_clips"), F.sum(close("short", "left") + close("short", "right")).alias("short_junction_clips")
    )
    mates = [c.alias(name) for c, name in zip(st.placed(MATE_NEAR, MATE_FAR), ("mate_point", "mate_first", "mate_last"), strict=True)]
    known = shaped.select(*KEYS, "left_junction", "right_junction", "clip_mode", *mates).join(beside, KEYS)
    five_prime = F.struct("reverse", F.when(F.col("reverse"), F.col("end")).otherwise(F.col("start")))
    counted = rows.groupBy(*KEYS).agg(
        F.count_distinct("read").alias("support"),
        F.count_distinct(five_prime).alias("distinct_starts"),
        F.min("position").alias("start"),
        F.max("position").alias("end"),
        count(clip).alias("clips"),
        count(clip & (F.col("side") == LEFT)).alias("left_side_clips"),
        count(clip & (F.col("side") == RIGHT)).alias("right_side_clips"),
        *[count(F.col("kind") == k).alias(k) for k in ("mate_unmapped", "mate_low_mapq", "mate_elsewhere", "large_insert")],
        count(clip & F.col("short")).alias("short_clips"),
        count(clip & F.col("supplementary")).alias("supplementary_clips"),
        count(F.col("tail").isNotNull()).alias("tail_clips"),
        count(F.col("tail.base") == "A").alias("polya_clips"),
        count(F.col("tail.base") == "T").alias("polyt_clips"),
        count(F.col("kind") == "mate_unmapped").alias("unmapped_mates"),
        count(~clip & (F.col("kind") != "mate_unmapped")).alias("discordant_mates"),
        (F.min("side") != F.max("side")).alias("both_sides"),
        F.max("tail.length").alias("tail_length"),
        F.min_by("position", F.struct("position", "side", "read")).alias("first_signal"),
    )
    both = counted.join(known, KEYS)
    junction_clips = F.coalesce(F.col("left_clips") + F.col("right_clips"), F.lit(0))
    by_clips = (junction_clips >= options.min_clips) | F.col("mate_point").isNull()
    gap = F.col("left_junction") - F.col("right_junction")
    tsd = F.when((F.col("left_clips") >= options.min_clips) & (F.col("right_clips") >= options.min_clips) & gap.between(1, LONGEST_TSD), gap)
    chosen = both.withColumn("junction_clips", junction_clips).withColumn("by_clips", by_clips & F.col("clip_mode").isNotNull()).withColumn("tsd", tsd)
    point = F.when(F.col("by_clips"), F.col("clip_mode")).otherwise(F.coalesce("mate_point", "first_signal"))
    chosen = chosen.withColumn("breakpoint", point)
    for c in ("mate_first", "mate_last"):
        chosen = chosen.withColumn(c, F.when(~F.col("by_clips"), F.col(c)))
    early = [(F.col("support") < options.min_support, "low_support"), (F.col("junction_clips") < options.min_clips, "no_junction")]
    if options.require_tail:
        early.append((F.col("tail_clips") == 0, "no_tail"))
    return chosen.withColumn("filters", sc.reason_list(early)).drop("clip_mode", "mate_point", "first_signal", "by_clips")


def with_depth(candidates: DataFrame, reads: DataFrame, options: Reading) -> DataFrame:
    """Add the kept reads over each breakpoint, and the signals' share of them."""
    points = candidates.select(*KEYS, "breakpoint").withColumnRenamed("contig", "p_contig")
    kept = reads.where(exclusion(options) == "kept").where("start is not null").select(F.col("contig").alias("r_contig"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    deep = iv.depth_at(points, kept, [("p_contig", "r_contig")], "breakpoint", (F.col("r_start"), F.col("r_end")))
    joined = candidates.join(deep.select(F.col("p_contig").alias("contig"), "cluster_start", "depth"), KEYS)
    return joined.withColumn("signal_ratio", sc.signal_ratio(F.col("support"), F.col("depth")))


def at_probe_edges(rows: DataFrame, probes: DataFrame, tolerance: int) -> DataFrame:
    """For each cluster with clips whether all of them lie at an edge of a probe. probes: contig, start, end (ranks)."""
    edges = probes.select(F.col("contig").alias("e_contig"), F.explode(F.array("start", "end")).alias("edge")).distinct()
    points = rows.where("kind = 'soft_clip'").select(*KEYS, "position").distinct()
    near = iv.nearest_edge(points, edges, [("contig", "e_contig")], "position", "edge", tolerance)
    both = points.join(near, [*KEYS, "position"], "left")
    return both.groupBy(*KEYS).agg(F.every(F.col("distance").isNotNull()).alias("only_edges"))


# Fixed values of the filters: least identity of the mates of a candidate that they type, and of one without
# junction clips; its least MEI mates and their share; typed clips that outweigh the depth.
MATE_IDENTITY, MATE_ONLY_IDENTITY = 0.96, 0.98
MATE_ONLY_MATES, MATE_ONLY_SHARE = 4, 0.6
CLIPS_BEYOND_RATIO = 5

#: What later steps add to a candidate, and its value before them (and without them).
LATER = {
    "family": "string", "subfamily": "string", "reverse": "boolean", "element_start": "int", "element_end": "int", "identity": "double",
    "typed_clips": "int", "short_typed_clips": "int", "by_mates": "boolean", "checked_mates": "long", "mei_mates": "long", "tail_mates": "long",
    "mate_identity": "double", "reference_copy": "boolean", "breakpoint_clips": "long", "only_edges": "boolean",
}
_NULL = ("family", "subfamily", "reverse", "element_start", "element_end", "identity", "mate_identity")


def with_later(candidates: DataFrame) -> DataFrame:
    """Add the columns of later steps that aren't there yet: null, 0 or false."""
    for name, kind in LATER.items():
        if name not in candidates.columns:
            start = None if name in _NULL else False if kind == "boolean" else 0
            candidates = candidates.withColumn(name, F.lit(start).cast(kind))
    return candidates


def mostly_mei() -> Column:
    """Whether most of the mates that were looked at, and enough of them, are of an element."""
    return (F.col("mei_mates") >= MATE_ONLY_MATES) & (F.col("mei_mates") / F.greatest("checked_mates", F.lit(1)) >= MATE_ONLY_SHARE)


def mate_only() -> Column:
    """Whether a candidate without enough junction clips is an insertion by its mates: typed, young, with some clip at its breakpoint."""
    identity = F.when(F.col("by_mates"), F.col("identity")).otherwise(F.col("mate_identity"))
    clipped = F.col("breakpoint_clips") + F.col("junction_clips") > 0
    told = F.col("family").isNotNull() & F.array_contains("filters", "no_junction") & ~F.col("reference_copy") & clipped & mostly_mei() & (identity >= MATE_ONLY_IDENTITY)
    return F.coalesce(told, F.lit(False))


def may_pass() -> Column:
    """Whether a candidate can pass once its mates are known: typed, with enough junction clips."""
    return F.col("family").isNotNull() & ~F.array_contains("filters", "no_junction")


def features() -> dict[str, Column]:
    """The seven features of the quality score, over the columns of a candidate."""
    return {
        "both_junctions": (F.col("left_clips") > 0) & (F.col("right_clips") > 0),
        "tail": F.col("tail_clips") > 0,
        "tsd": F.col("tsd").isNotNull(),
        "identity": F.col("identity") >= 0.98,
        "distinct_starts": F.col("distinct_starts").cast("double") / F.col("support") >= 0.7,
        "mei_mates": F.col("mei_mates") / F.nullif(F.col("checked_mates"), F.lit(0)) >= 0.6,
        "ratio": F.col("signal_ratio") >= 0.2,
    }


def judged(candidates: DataFrame, options: Calling) -> DataFrame:
    """Add the late filters, quality and confidence.

    Short clips count only where some mate is of an element: else they are left out of the
    junction clips and of the typed ones. Filters stand in the order in which they are found,
    but a late no_junction comes right after low_support.
    """
    rows = with_later(candidates).withColumn("_alone", mate_only())
    none = F.array().cast("array<string>")
    some = F.col("mei_mates") > 0
    tailed = F.col("tail_clips") > 0
    typed = F.coalesce("typed_clips", F.lit(0))
    counted = F.when(some, typed).otherwise(F.greatest(typed - F.coalesce("short_typed_clips", F.lit(0)), F.lit(0)))
    known = F.when(F.col("_alone"), F.array_remove("filters", "no_junction")).otherwise(F.col("filters"))
    short = ~some & ~F.col("_alone") & (F.greatest(F.col("junction_clips") - F.col("short_junction_clips"), F.lit(0)) < options.min_clips) & ~F.array_contains("filters", "no_junction")
    low = F.filter(known, lambda x: x == "low_support")
    known = F.when(short, F.concat(low, F.array(F.lit("no_junction")), F.filter(known, lambda x: x != "low_support"))).otherwise(known)
    enough_mates = F.col("mei_mates") >= options.min_typed_clips
    by_mates = F.coalesce(F.col("by_mates"), F.lit(False)) & ~F.col("reference_copy") & (F.col("identity") >= MATE_IDENTITY) & (F.col("tail_clips") >= options.min_typed_clips) & enough_mates
    ways = [counted >= options.min_typed_clips, (counted >= 1) & tailed & enough_mates, (counted >= 1) & mostly_mei() & (F.col("mate_identity") >= MATE_IDENTITY), by_mates, F.col("_alone")]
    is_typed = F.lit(False)
    for way in ways:
        is_typed = is_typed | F.coalesce(way, F.lit(False))
    hallmark = tailed | F.col("tsd").isNotNull() | (typed > 0)
    late = sc.reason_list([
        (~is_typed, "untyped"),
        ((F.col("checked_mates") > 0) & (F.col("mei_mates") < options.min_mei_mate_fraction * F.col("checked_mates")), "non_mei_mates"),
        (F.col("only_edges") & ~hallmark, "probe_edge"),
        ((counted < CLIPS_BEYOND_RATIO) & (F.col("signal_ratio") < options.min_signal_ratio), "low_ratio"),
    ])
    rated = rows.withColumn("filters", F.concat(known, late)).withColumn("qual", sc.quality_score(features()))
    rated = rated.withColumn("passes_before_quality", F.size("filters") == 0)
    poor = F.when(F.col("qual") < options.least_quality, F.array(F.lit("low_qual"))).otherwise(none)
    rated = rated.withColumn("filters", F.concat("filters", poor))
    return rated.withColumn("confidence", sc.confidence(F.size("filters") == 0, tailed, F.coalesce("by_mates", F.lit(False)), F.col("tsd").isNotNull())).drop("_alone")


def allele_counts(sites: DataFrame, reads: DataFrame, overhang: int, slack: int = ALLELE_SLACK) -> DataFrame:
    """Reads of each allele at sites (site, s_contig, left, right): site, alt_left, alt_right, ref_reads.

    reads: contig, start, end, left_clip and right_clip (lengths of good clips, else 0). A read
    whose clip of ``overhang`` bases ends within ``slack`` of its junction speaks for the
    insertion; one that covers the whole site and as many bases on both sides, and doesn't,
    speaks against it. Only reads that overlap the site or a base beside it count. A site
    without a junction has zeros.
    """
    spans = sites.withColumn("low", F.least("left", "right")).withColumn("high", F.greatest("left", "right"))
    kept = reads.select(F.col("contig").alias("r_contig"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "left_clip", "right_clip")
    near = (F.greatest(F.col("low") - 1, F.lit(0)), F.col("high") + 1)
    pairs = iv.overlap_join(spans.where("low is not null"), kept, [("s_contig", "r_contig")], near, (F.col("r_start"), F.col("r_end")))
    no = lambda c: F.coalesce(c, F.lit(False))
    left = no((F.col("right_clip") >= overhang) & (F.abs(F.col("r_end") - F.col("left")) <= slack))
    right = no((F.col("left_clip") >= overhang) & (F.abs(F.col("r_start") - F.col("right")) <= slack))
    whole = (F.col("r_start") + overhang <= F.col("low")) & (F.col("r_end") >= F.col("high") + overhang)
    counts = pairs.groupBy("site").agg(F.count_if(left).alias("alt_left"), F.count_if(right).alias("alt_right"), F.count_if(whole & ~left & ~right).alias("ref_reads"))
    return sites.select("site").join(counts, "site", "left").na.fill(0, ["alt_left", "alt_right", "ref_reads"])


def _good_clips(reads: DataFrame, options: Reading) -> DataFrame:
    """left_clip and right_clip of the kept reads: their lengths, or 0 where the median quality is low."""
    from ..functions.sequences import soft_clips
    from .extract import _qualities, lower_median

    kept = reads.where(exclusion(options) == "kept").where("start is not null").withColumn("c", soft_clips(F.col("cigar")))
    quality = _qualities(F.col("qual"))
    whole = F.size(quality)
    # the qualities of most reads are never looked at: only a long clip's count
    left = F.when(F.col("c.left") >= options.overhang, F.when((whole < F.col("c.left")) | (lower_median(F.slice(quality, F.lit(1), F.greatest("c.left", F.lit(1)))) >= options.min_clip_quality), F.col("c.left")).otherwise(0)).otherwise(0)
    ending = F.slice(quality, F.greatest(whole - F.col("c.right") + 1, F.lit(1)), F.greatest("c.right", F.lit(1)))
    right = F.when(F.col("c.right") >= options.overhang, F.when(lower_median(ending) >= options.min_clip_quality, F.col("c.right")).otherwise(0)).otherwise(0)
    return kept.withColumn("left_clip", left).withColumn("right_clip", right)


def genotyped(candidates: DataFrame, reads: DataFrame, options: Reading) -> DataFrame:
    """Add allele counts and the genotype (struct of call, quality and likelihoods; null without a junction).

    Reference reads count once for each junction.
    """
    sites = candidates.select(F.struct(*KEYS).alias("site"), F.col("contig").alias("s_contig"), F.col("left_junction").alias("left"), F.col("right_junction").alias("right"))
    counts = allele_counts(sites, _good_clips(reads, options), options.overhang).select("site.*", "alt_left", "alt_right", "ref_reads")
    joined = candidates.join(counts, KEYS, "left").na.fill(0, ["alt_left", "alt_right", "ref_reads"])
    joined = joined.withColumn("alt_reads", F.col("alt_left") + F.col("alt_right")).withColumn("junctions", F.col("left_junction").isNotNull().cast("int") + F.col("right_junction").isNotNull().cast("int"))
    joined = joined.withColumn("ref_reads", F.col("ref_reads") * F.col("junctions"))
    call = sc.genotype(F.col("alt_reads"), F.col("ref_reads"), F.col("junctions"), F.col("passes_before_quality"), F.col("depth"))
    return joined.withColumn("genotype", F.when(F.col("junctions") > 0, call))
