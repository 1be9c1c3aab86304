"""Typing of sequences by element consensus: shared k-mers, densest bands, then alignment of few windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.alignment import local_alignment
from ..functions.sequences import reverse_complement, without_tail
from ..operators import positions as po
from ..operators import statistics as st
from ..storage import staged

# Fixed values of the method: k-mer size, shortest sequence, that from which two seeds are needed,
# windows aligned for a sequence, bases around a window, and the least coverage and identity.
KMER, SHORTEST, TWO_SEEDS, WINDOWS, AROUND = 11, 15, 25, 8, 30
COVERAGE, IDENTITY = 0.7, 0.9


def strands(consensus: DataFrame) -> DataFrame:
    """Both strands of each consensus: cid, reverse, strand, strand_length."""
    forward = consensus.select("cid", F.lit(False).alias("reverse"), F.upper("seq").alias("strand"))
    back = consensus.select("cid", F.lit(True).alias("reverse"), reverse_complement(F.upper("seq")).alias("strand"))
    return forward.unionAll(back).withColumn("strand_length", F.length("strand"))


def hits(sequences: DataFrame, consensus: DataFrame) -> DataFrame:
    """Consensus hits of sequences (id, seq): id, cid, reverse, score, identity, element_start, element_end.

    For each sequence and consensus the better strand counts (the forward one of equals).
    Positions are those on the consensus itself. Ids are distinct.
    """
    both = strands(consensus)
    long = sequences.select("id", F.upper("seq").alias("seq")).where(F.length("seq") >= SHORTEST)
    named = both.select((F.col("cid").cast("long") * 2 + F.col("reverse").cast("long")).alias("ref"), F.col("strand").alias("seq"))
    found = seeds.bands(long, named, KMER).withColumn("cid", F.expr("cast(ref div 2 as int)")).withColumn("reverse", F.col("ref") % 2 == 1).drop("ref")
    bands = found.join(long, "id")
    enough = bands.where(F.col("seeds") >= F.when(F.length("seq") >= TWO_SEEDS, 2).otherwise(1))
    few = po.top_rows(enough, ["id"], [F.desc("seeds"), F.asc("cid"), F.asc("reverse")], WINDOWS)
    windows = few.join(both, ["cid", "reverse"])
    low = F.greatest(F.col("first") - AROUND, F.lit(0))
    high = F.least(F.col("last") + F.length("seq") + AROUND, F.col("strand_length"))
    cut = windows.withColumn("low", low).where(high > low).withColumn("target", F.substring(F.col("strand"), (F.col("low") + 1).cast("int"), (high - F.col("low")).cast("int")))
    aligned = cut.withColumn("a", local_alignment(F.col("seq"), F.col("target")))
    covered = (F.col("a.query_end") - F.col("a.query_start")) / F.length("seq")
    identity = F.col("a.matches") / F.greatest(F.col("a.columns"), F.lit(1))
    good = aligned.where((covered >= COVERAGE) & (identity >= IDENTITY))
    start, end = F.col("low") + F.col("a.target_start"), F.col("low") + F.col("a.target_end")
    placed = good.select("id", "cid", "reverse", F.col("a.score").alias("score"), identity.alias("identity"), F.when(F.col("reverse"), F.col("strand_length") - end).otherwise(start).alias("element_start"), F.when(F.col("reverse"), F.col("strand_length") - start).otherwise(end).alias("element_end"))
    return po.top_rows(placed, ["id", "cid"], [F.desc("score"), F.asc("reverse")], 1).drop("rank")


def hits_of(rows: DataFrame, consensus: DataFrame, seq: str = "seq") -> DataFrame:
    """Join rows with the hits of their sequence: cid, family, name, reverse, score, identity, element_start, element_end.

    Each distinct sequence is typed once; rows without a hit are left out.
    """
    distinct = rows.where(F.col(seq).isNotNull()).select(F.col(seq).alias("id"), F.col(seq).alias("seq")).distinct()
    found = hits(distinct, consensus).join(consensus.select("cid", "family", "name"), "cid")
    return rows.join(found.withColumnRenamed("id", "_seq"), F.col(seq) == F.col("_seq")).drop("_seq")


def best_hits(typed: DataFrame, keys: list[str]) -> DataFrame:
    """Of several hits of one sequence (its keys) the one of the highest score, then of the first consensus and strand."""
    names = [c for c in typed.columns if c not in keys]
    best = F.min_by(F.struct(*names), F.struct(-F.col("score"), F.col("cid"), F.col("reverse")))
    return typed.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def families(typed: DataFrame, consensus: DataFrame, keys: list[str]) -> DataFrame:
    """The family with most score over the sequences of each key; ties in the order ALU, LINE1, SVA.

    typed are hits with the keys of their sequences added.
    """
    named = typed.join(consensus.select("cid", "family"), "cid")
    return st.vote(named.withColumn("rank", F.col("family")), keys, "id", "family", "rank", "score")


def clip_vote(typed: DataFrame, keys: list[str], voter: str) -> DataFrame:
    """The element of each key by the hits of its clips (voter, short, and columns of hits_of).

    Returns family, typed_clips and short_typed_clips (those with a hit of that family),
    subfamily (the consensus of the family with most score, the first of equals), reverse (by
    the sum of its scores, signed by strand), identity (mean) and the span of its hits.
    """
    typed = staged(typed, "hits")
    best = st.dealt(typed, [*keys, "family", voter], typed.count()).groupBy(*keys, "family", voter).agg(F.max("score").alias("_s"), F.max("short").alias("_short"))
    sums = best.groupBy(*keys, "family").agg(F.sum("_s").alias("_total"), F.count("*").alias("typed_clips"), F.count_if("_short").alias("short_typed_clips"))
    first = F.min_by(F.struct("family", "typed_clips", "short_typed_clips"), F.struct(-F.col("_total"), F.col("family")))
    chosen = sums.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")
    return subfamily_vote(typed, chosen, keys).select(*keys, "family", F.col("name").alias("subfamily"), "reverse", "element_start", "element_end", "identity", "typed_clips", "short_typed_clips", F.lit(False).alias("by_mates"))


def subfamily_vote(typed: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the consensus of its chosen family with most score (score_of_best; the first of equals), and its hits in sum.

    Hits of all families are summed before the chosen ones are joined, so that no key's hits come to one task.
    """
    on = [*keys, "family"]
    signed = F.sum(F.when(F.col("reverse"), F.col("score")).otherwise(-F.col("score")))
    extent = [F.min("element_start").alias("element_start"), F.max("element_end").alias("element_end")]
    # names are keys first: to look for the least of them Spark would sort all hits
    by_name = typed.groupBy(*on, "cid", "name").agg(F.sum("score").alias("_score"), signed.alias("_signed"), F.sum("identity").alias("_identity"), F.count("identity").alias("_n"), *extent)
    identity = F.sum("_identity") / F.nullif(F.sum("_n"), F.lit(0))
    summed = by_name.groupBy(*on, "cid").agg(F.min("name").alias("name"), F.sum("_score").alias("score_of_best"), (F.sum("_signed") > 0).alias("reverse"), identity.alias("identity"), *extent)
    by_cid = chosen.select(*on).join(summed, on)
    names = ["name", "cid", "score_of_best", "reverse", "identity", "element_start", "element_end"]
    best = F.min_by(F.struct(*names), F.struct(-F.col("score_of_best"), F.col("cid")))
    return chosen.join(by_cid.groupBy(*on).agg(best.alias("_b")).select(*on, "_b.*"), on)


def mate_vote(best: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """The element of each key by its mates' best hits, where ``least`` mates or more have one family.

    The family of most mates counts, then of most score. Its subfamily is named only if one
    consensus has more than half of the family's score; else the family's name stands for it.
    """
    sums = best.groupBy(*keys, "family").agg(F.count("*").alias("mates"), F.sum("score").alias("family_score"))
    first = F.min_by(F.struct("family", "mates", "family_score"), F.struct(-F.col("mates"), -F.col("family_score"), F.col("family")))
    chosen = sums.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*").where(F.col("mates") >= least)
    named = subfamily_vote(best, chosen, keys)
    clear = 2 * F.col("score_of_best") > F.col("family_score")
    return named.select(*keys, "family", F.when(clear, F.col("name")).otherwise(F.col("family")).alias("subfamily"), "element_start", "element_end", "identity", "mates")


def junction_clips(rows: DataFrame, candidates: DataFrame, keys: list[str], near: int = 2) -> DataFrame:
    """The clips at their candidate's junctions: keys, clip (names it), side, position, short, tail, clip's sequence and ``bare``.

    bare is the sequence without the pure run of its tail.
    """
    at = rows.where("kind = 'soft_clip'").join(candidates.select(*keys, "left_junction", "right_junction"), keys)
    junction = F.when(F.col("side") == 1, F.col("left_junction")).otherwise(F.col("right_junction"))
    named = at.where(F.abs(F.col("position") - junction) <= near)
    bare = without_tail(F.upper("clip"), F.col("tail.base"), F.col("side") == 0)
    return named.select(*keys, F.struct("read", "first_segment", "side", "position").alias("voter"), "side", "position", "short", "tail", F.upper("clip").alias("seq"), bare.alias("bare"))


def type_clips(clips: DataFrame, consensus: DataFrame, keys: list[str]) -> DataFrame:
    """The element of each candidate by its junction clips (see junction_clips and clip_vote)."""
    return clip_vote(hits_of(clips.select(*keys, "voter", "short", "bare"), consensus, "bare"), keys, "voter")
