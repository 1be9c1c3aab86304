"""Steps that look again at the reads and the reference around candidates: tracts, breakpoints and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assembly as asm
from ..functions import sequences as sq
from ..functions import tracts
from ..operators import intervals as iv
from ..operators import positions as po
from ..options import Reading
from ..sources.text import bases
from . import typing
from .candidates import KEYS, LONGEST_TSD, mate_only, may_pass
from .extract import exclusion

# Fixed values of the method: reference beside a breakpoint, clips that a tract must explain; shortest clip at a
# breakpoint; slack at a junction, reads for each side, and bases beside a site from which they are taken.
AROUND, EXPLAINED = 250, 2
SHORT_CLIP = 3
SLACK, MOST_READS, MARGIN = 5, 300, 300


def _windows(candidates: DataFrame, contigs: DataFrame, reference: DataFrame) -> DataFrame:
    """KEYS, window_start and window: the reference around each breakpoint, cut at the contig's ends."""
    named = F.broadcast(contigs.select(F.col("rank").alias("contig"), F.col("name").alias("_name")))
    sites = candidates.select(*KEYS, F.greatest(F.col("breakpoint") - AROUND, F.lit(0)).alias("window_start"), (F.col("breakpoint") + AROUND).alias("_end")).join(named, "contig")
    found = bases(sites, reference, "_name", F.col("window_start"), F.col("_end"))
    return found.where("window is not null").select(*KEYS, "window_start", "window")


def tandem_repeats(clips: DataFrame, candidates: DataFrame, contigs: DataFrame, reference: DataFrame) -> DataFrame:
    """Candidates with tandem_repeat among their filters where longer tracts of the reference explain their clips.

    clips as of typing.junction_clips. Either two clips, and half of those that tell anything,
    end where the reference goes on; or tails are all there is, at a long run of their base.
    """
    around = _windows(candidates.where("left_junction is not null or right_junction is not null"), contigs, reference)
    at = clips.join(around, KEYS)
    told = at.withColumn("_t", tracts.against_reference(F.col("seq"), F.col("side"), F.col("position") - F.col("window_start"), F.col("tail.base"), F.col("tail.length"), F.col("window")))
    sums = told.groupBy(*KEYS).agg(
        F.count("_t.found").alias("_informative"),
        F.count_if(F.coalesce("_t.found", F.lit(False))).alias("_explained"),
        F.count("tail").alias("_tails"),
        F.count_if(F.coalesce("_t.beyond_tail", F.lit(False))).alias("_beyond"),
        F.count_if("_t.homopolymer").alias("_runs"),
    )
    by_clips = (F.col("_explained") >= EXPLAINED) & (2 * F.col("_explained") >= F.col("_informative"))
    by_run = (F.col("_tails") > 0) & (F.col("_beyond") == 0) & (F.col("_runs") > 0)
    flagged = sums.where(by_clips | by_run).select(*KEYS, F.lit(True).alias("_tract"))
    joined = candidates.join(flagged, KEYS, "left")
    return joined.withColumn("filters", F.when(F.col("_tract"), F.array_append("filters", "tandem_repeat")).otherwise(F.col("filters"))).drop("_tract")


def breakpoints(requests: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary inside each request at which most reads are clipped: keys, boundary and votes.

    requests: keys, q_contig, first, last (inclusive) and estimate. reads: contig, start, end,
    left_clip, right_clip. Two reads at least; ties as in positions.best_boundary.
    """
    ends = F.array(F.struct(F.col("left_clip").alias("n"), F.col("start").alias("boundary")), F.struct(F.col("right_clip").alias("n"), F.col("end").alias("boundary")))
    clipped = reads.where(F.greatest("left_clip", "right_clip") >= SHORT_CLIP).select(F.col("contig").alias("r_contig"), F.inline(ends)).where(F.col("n") >= SHORT_CLIP)
    pairs = iv.overlap_join(requests, clipped, [("q_contig", "r_contig")], (F.col("first"), F.col("last") + 1), (F.col("boundary"), F.col("boundary") + 1))
    return po.best_boundary(pairs, keys, "boundary", "estimate")


def clipped_reads(reads: DataFrame, options: Reading) -> DataFrame:
    """The kept, placed reads with the lengths of their clips."""
    kept = reads.where(exclusion(options) == "kept").where("start is not null").withColumn("_c", sq.soft_clips(F.col("cigar")))
    return kept.withColumn("left_clip", F.col("_c.left")).withColumn("right_clip", F.col("_c.right")).drop("_c")


def located(candidates: DataFrame, reads: DataFrame, options: Reading, least_mates: int = 2) -> DataFrame:
    """Move candidates that their mates place to a boundary where reads are clipped by a few bases.

    Only those with enough MEI mates are looked for; where a boundary is found, it is the
    breakpoint (with breakpoint_clips), and the interval of the mates goes. moved tells them.
    """
    chosen = candidates.where(F.col("mei_mates") >= least_mates).where("mate_first is not null")
    requests = chosen.select(*[F.col(k).alias(f"q_{k}") for k in KEYS], F.greatest("mate_first", F.lit(0)).alias("first"), F.col("mate_last").alias("last"), F.col("breakpoint").alias("estimate"))
    found = breakpoints(requests, clipped_reads(reads, options), [f"q_{k}" for k in KEYS])
    slim = found.select(*[F.col(f"q_{k}").alias(k) for k in KEYS], F.col("boundary").alias("_at"), F.col("votes").alias("_votes"))
    joined = candidates.drop("breakpoint_clips").join(slim, KEYS, "left")
    moved = F.col("_at").isNotNull()
    joined = joined.withColumn("moved", moved).withColumn("breakpoint", F.coalesce("_at", "breakpoint")).withColumn("breakpoint_clips", F.coalesce("_votes", F.lit(0)).cast("long"))
    for c in ("mate_first", "mate_last"):
        joined = joined.withColumn(c, F.when(~F.col("moved"), F.col(c)))
    return joined.drop("_at", "_votes")


def junction_reads(requests: DataFrame, reads: DataFrame, keys: list[str], order: list[str], most: int = MOST_READS) -> DataFrame:
    """The first reads of each request and set: keys, role (left, right or inside), seq and rank.

    requests: keys, q_contig, low and high (a window), left and right (junctions, may be null).
    Only reads that overlap the window count.
    reads: contig, start, end, unmapped, left_clip, right_clip, seq and the columns of
    ``order``, which leave no ties. A read clipped on its right end near the left junction is
    of role left, and the other way round; an unmapped read placed in the window is inside.
    """
    place = F.when(F.col("unmapped"), F.col("start") + 1).otherwise(F.greatest("end", F.col("start") + 1))
    useful = reads.where(F.col("unmapped") | (F.col("left_clip") > 0) | (F.col("right_clip") > 0)).withColumnRenamed("contig", "r_contig")
    pairs = iv.overlap_join(requests, useful, [("q_contig", "r_contig")], (F.col("low"), F.col("high")), (F.col("start"), place))

    def close(junction: str, end: Column, clip: str) -> Column:
        return ~F.col("unmapped") & (F.col(clip) > 0) & F.coalesce(F.abs(end - F.col(junction)) <= SLACK, F.lit(False))

    inside = F.col("unmapped") & (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high"))
    roles = F.array_compact(F.array(F.when(close("left", F.col("end"), "right_clip"), F.lit("left")), F.when(close("right", F.col("start"), "left_clip"), F.lit("right")), F.when(inside, F.lit("inside"))))
    tall = pairs.select(*keys, *order, "seq", F.explode(roles).alias("role"))
    return po.top_rows(tall, [*keys, "role"], [F.col(c) for c in order], most).select(*keys, "role", "seq", "rank")


def window_reads(reads: DataFrame, options: Reading) -> DataFrame:
    """Kept reads with their clips, and placed unmapped reads of mapped mates, all with masked bases; with their place in the file if they have it."""
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    anchored = clipped_reads(reads, options).where(~bit(4)).withColumn("unmapped", F.lit(False))
    loose = reads.where(bit(4) & ~bit(8) & ~bit(256) & ~bit(2048)).where("start is not null").withColumn("left_clip", F.lit(0)).withColumn("right_clip", F.lit(0)).withColumn("unmapped", F.lit(True))
    both = anchored.select(*loose.columns).unionByName(loose).where("seq is not null")
    return both.select("contig", "start", "end", "name", "flag", "unmapped", "left_clip", "right_clip", sq.masked_bases(F.col("seq"), F.col("qual")).alias("seq"), *[c for c in ["at"] if c in reads.columns])


def assembled(candidates: DataFrame, reads: DataFrame, contigs: DataFrame, reference: DataFrame, consensus: DataFrame, options: Reading) -> DataFrame:
    """Add the assembly of candidates that can pass, and take its junctions and duplicated site.

    A candidate that its mates place has no junction: its breakpoint is tried as either, and a
    side stays whose insert has a tail there or is of the candidate's family. Adds assembled
    (both, left, right, none; null if it wasn't tried), tsd_bases, tail_run, left_contig,
    left_insert, right_contig and right_insert.
    """
    chosen = candidates.where(may_pass() | mate_only()).withColumn("_by_clips", may_pass())
    has = F.col("left_junction").isNotNull() | F.col("right_junction").isNotNull()
    at_breakpoint = ~F.col("_by_clips") & ~has
    taken = [F.when(at_breakpoint, F.col("breakpoint")).otherwise(F.col(c)) for c in ("left_junction", "right_junction")]
    lengths = F.broadcast(contigs.select(F.col("rank").alias("contig"), F.col("length").alias("_length")))
    windows = _windows(chosen, contigs, reference)
    sites = chosen.join(windows, KEYS).join(lengths, "contig").select(*KEYS, "window_start", "window", "_by_clips", "breakpoint", "family", "start", "end", "_length", taken[0].alias("left"), taken[1].alias("right"))
    low = F.greatest(F.least("start", "left", "right") - MARGIN, F.lit(0))
    high = F.least(F.greatest("end", "left", "right") + MARGIN, F.col("_length"))
    requests = sites.select(*[F.col(k).alias(f"q_{k}") for k in KEYS], low.alias("low"), high.alias("high"), "left", "right")
    # of very many reads the first of the file count
    order = ["at"] if "at" in reads.columns else ["start", "name", "flag", "seq"]
    found = junction_reads(requests, window_reads(reads, options), [f"q_{k}" for k in KEYS], order)
    in_order = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("rank", "seq")))), lambda x: x["seq"]).alias(f"{role}_reads")
    grouped = found.groupBy(*[F.col(f"q_{k}").alias(k) for k in KEYS]).agg(*[in_order(r) for r in ("left", "right", "inside")])
    none = F.array().cast("array<string>")
    ready = sites.join(grouped, KEYS, "left")
    columns = {c: F.coalesce(f"{c}_reads" if c == "inside" else c, none) for c in ("left_reads", "right_reads", "inside")} | {"window": F.col("window"), "start": F.col("window_start")}

    def tried(left: Column, right: Column) -> Column:
        return asm.assembled(columns | {"left": left, "right": right}, options.polya_min_len, options.polya_min_frac)

    nothing = F.lit(None).cast("long")
    by_clips = ready.where("_by_clips").select(*KEYS, tried(F.col("left"), F.col("right")).alias("a"))
    beside = ready.where("not _by_clips")
    alone = beside.select("*", tried(F.col("breakpoint"), nothing).alias("l"), tried(nothing, F.col("breakpoint")).alias("r"))
    inserts = alone.select(*KEYS, "family", F.explode(F.array(F.struct(F.lit("l").alias("side"), sq.without_runs(F.col("l.left_insert")).alias("bare")), F.struct(F.lit("r").alias("side"), sq.without_runs(F.col("r.right_insert")).alias("bare")))).alias("i")).select(*KEYS, F.col("family").alias("own"), "i.side", "i.bare")
    elements = typing.hits_of(inserts, consensus, "bare").where("family = own").groupBy(*KEYS).agg(F.max(F.col("side") == "l").alias("l_element"), F.max(F.col("side") == "r").alias("r_element"))
    judged = alone.join(elements, KEYS, "left")
    keep_l = F.col("l.left_junction").isNotNull() & (F.col("l.tail_base").isNotNull() | F.coalesce("l_element", F.lit(False)))
    keep_r = F.col("r.right_junction").isNotNull() & (F.col("r.tail_base").isNotNull() | F.coalesce("r_element", F.lit(False)))
    sided = judged.withColumn("_l", keep_l).withColumn("_r", keep_r)
    again = sided.select(*KEYS, tried(F.when(F.col("_l"), F.col("breakpoint")), F.when(F.col("_r"), F.col("breakpoint"))).alias("a"))
    results = by_clips.unionByName(again).select(*KEYS, "a.*").withColumnRenamed("tail_length", "tail_run")

    joined = candidates.join(results.withColumnRenamed("left_junction", "_left").withColumnRenamed("right_junction", "_right").withColumn("_tried", F.lit(True)), KEYS, "left").join(windows, KEYS, "left")
    left, right = F.col("_left").isNotNull(), F.col("_right").isNotNull()
    gap = F.col("_left") - F.col("_right")
    site = F.when(left & right & gap.between(1, LONGEST_TSD), F.substring(F.col("window"), (F.col("_right") - F.col("window_start") + 1).cast("int"), gap.cast("int")))
    named = joined.withColumn("tsd_bases", F.nullif(site, F.lit("")))
    named = named.withColumn("assembled", F.when(F.col("_tried"), F.when(left & right, F.lit("both")).when(left, F.lit("left")).when(right, F.lit("right")).otherwise(F.lit("none"))))
    named = named.withColumn("tsd", F.when(left & right, F.length("tsd_bases").cast("long")).otherwise(F.col("tsd")))
    named = named.withColumn("left_junction", F.coalesce("_left", "left_junction")).withColumn("right_junction", F.coalesce("_right", "right_junction"))
    return named.drop("_left", "_right", "_tried", "window", "window_start")
