"""Mates of a candidate's reads held against the element consensus, and against the reference beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import positions as po
from ..sources.text import bases
from ..storage import staged
from . import typing
from .candidates import KEYS

# Fixed values of the method: mates looked at, fewest mate signals and least ratio of a candidate without clips,
# least run of a mate in a tail, shortest mate, bases beside the candidate, k-mers shared by a local mate,
# and bases beside a site, pieces and steps in which a copy of its family is looked for.
MOST_MATES = 40
FEW_MATES, FEW_RATIO = 3, 0.2
TAIL_RUN, SHORTEST = 20, 50
BESIDE, SHARED = 600, 0.5
COPY_BESIDE, PIECE, STEP = 600, 100, 50


def checked() -> Column:
    """Whether a candidate's mates are looked at, over its columns.

    Those that are typed need enough junction clips, the others a clip with a tail; either can
    have many mate signals for its depth instead.
    """
    no_junction = F.array_contains("filters", "no_junction")
    mates = F.col("unmapped_mates") + F.col("discordant_mates")
    by_mates = no_junction & (mates >= FEW_MATES) & F.coalesce(F.col("signal_ratio") >= FEW_RATIO, F.lit(False))
    return by_mates | F.when(F.col("family").isNotNull(), ~no_junction).otherwise(F.col("tail_clips") > 0)


def sampled(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """At most MOST_MATES mate signals of each candidate that is looked at, evenly over their order."""
    signals = rows.where("kind = 'mate_unmapped' or (kind <> 'soft_clip' and mate_contig is not null and mate_start is not null)")
    chosen = signals.join(candidates.where(checked()).select(*KEYS), KEYS, "left_semi")
    return po.even_sample(chosen, KEYS, ["position", "side", "read", "first_segment", "kind"], MOST_MATES)


def unmapped_sequences(mates: DataFrame, reads: DataFrame) -> DataFrame:
    """Sequences of unmapped mates: the unmapped read of the same name placed where the anchor begins."""
    own = mates.where("kind = 'mate_unmapped'")
    there = reads.where(F.col("flag").bitwiseAND(4) != 0).where(F.col("flag").bitwiseAND(256 | 2048) == 0).where("seq is not null")
    lone = there.groupBy(F.col("name").alias("_name"), F.col("contig").alias("_contig"), F.col("start").alias("_start")).agg(F.max(F.upper("seq")).alias("seq"))
    return own.join(lone, (F.col("read") == F.col("_name")) & (F.col("contig") == F.col("_contig")) & (F.col("start") == F.col("_start"))).drop("_name", "_contig", "_start")


def mapped_sequences(mates: DataFrame, contigs: DataFrame, reference: DataFrame) -> DataFrame:
    """The reference at the place of mapped mates, as their sequence, to the contig's end at most."""
    known = F.broadcast(contigs.select(F.col("rank").alias("_rank"), F.col("name").alias("_mate_name"), F.col("length").alias("_length")))  # header rows
    located = mates.where("kind <> 'mate_unmapped'").join(known, F.col("mate_contig") == F.col("_rank")).drop("_rank")
    span = F.coalesce("mate_span", F.greatest(F.col("end") - F.col("start"), F.lit(SHORTEST)))
    placed = located.withColumn("_to", F.least(F.col("mate_start") + span, F.col("_length")))
    places = placed.select("_mate_name", "mate_start", "_to").distinct()
    found = bases(places, reference, "_mate_name", F.col("mate_start"), F.col("_to"), "seq")
    return placed.join(found, ["_mate_name", "mate_start", "_to"]).where("seq is not null").select(*mates.columns, "seq")


def local(mates: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    """Add ``local``: whether half of a mate's canonical k-mers (each as often as it occurs) lie in its candidate's window.

    mates: names (which tell a mate) and seq; windows: KEYS and window. Mates without k-mers aren't local.
    """
    own = mates.select(*names, F.explode(sq.canonical_kmers(F.upper("seq"))).alias("kmer"))
    there = windows.select(*KEYS, F.explode(F.array_distinct(sq.canonical_kmers(F.upper("window")))).alias("kmer")).withColumn("_in", F.lit(1))
    share = own.join(there, [*KEYS, "kmer"], "left").groupBy(*names).agg((F.count("_in") >= SHARED * F.count("*")).alias("local"))
    match = None
    for c in names:
        same = F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}"))
        match = same if match is None else match & same
    return mates.alias("m").join(share.alias("s"), match, "left").select("m.*", F.coalesce("s.local", F.lit(False)).alias("local"))


def check(rows: DataFrame, candidates: DataFrame, reads: DataFrame, consensus: DataFrame, contigs: DataFrame, reference: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Candidates with what their mates tell, and the mates that were looked at.

    Adds checked_mates, mei_mates, tail_mates and mate_identity; candidates that their clips
    don't type take the element of their mates (by_mates). Mapped mates need the reference.
    """
    names = [*KEYS, "read", "first_segment", "kind", "position", "side"]
    chosen = staged(sampled(rows, candidates), "mates")
    found = unmapped_sequences(chosen, reads).withColumn("local", F.lit(False))
    if reference is not None:
        mapped = staged(mapped_sequences(chosen, contigs, reference), "mapped-mates")
        spans = rows.groupBy(*KEYS).agg((F.min("start") - BESIDE).alias("_low"), (F.max("end") + BESIDE).alias("_high")).join(mapped.select(*KEYS).distinct(), KEYS, "left_semi")
        spans = spans.join(F.broadcast(contigs.select(F.col("rank").alias("contig"), F.col("name").alias("_name"))), "contig")
        windows = bases(spans, reference, "_name", F.col("_low"), F.col("_high"))
        found = found.unionByName(local(mapped, windows, names))
    found = staged(found.select(*names, "seq", "local"), "mate-sequences")
    typed = found.where(~F.col("local")).select(*names, sq.without_runs(F.col("seq")).alias("bare"))
    best = staged(typing.best_hits(typing.hits_of(typed, consensus, "bare"), names), "mate-hits")

    tails = candidates.where("family is null").select(*KEYS, F.col("polyt_clips") > F.col("polya_clips"))
    voted = typing.mate_vote(best.join(tails.select(*KEYS), KEYS, "left_semi"), KEYS)
    by_mates = {c: F.col(f"v.{c}") for c in ("family", "subfamily", "element_start", "element_end", "identity")}
    by_mates |= {"reverse": F.col("c.polyt_clips") > F.col("c.polya_clips"), "typed_clips": F.lit(0), "short_typed_clips": F.lit(0), "by_mates": F.lit(True)}
    joined = candidates.alias("c").join(voted.alias("v"), KEYS, "left")
    named = joined.select(*KEYS, *[F.when(F.col("v.family").isNotNull(), by_mates[c]).otherwise(F.col(f"c.{c}")).alias(c) if c in by_mates else F.col(f"c.{c}").alias(c) for c in candidates.columns if c not in KEYS])
    named = staged(named, "typed")

    hit = found.join(best.select(*names, F.col("family").alias("mate_family"), F.col("identity").alias("hit_identity")), names, "left")
    judged = hit.join(named.select(*KEYS, "family"), KEYS)
    mei = F.col("mate_family").isNotNull() & (F.col("family").isNull() | (F.col("family") == F.col("mate_family")))
    judged = judged.withColumn("mei", mei).withColumn("in_tail", F.col("mate_family").isNull() & (sq.longest_run(F.col("seq")) >= TAIL_RUN))
    counts = judged.groupBy(*KEYS).agg(F.count("*").alias("checked_mates"), F.count_if("mei").alias("mei_mates"), F.count_if("in_tail").alias("tail_mates"), F.avg(F.when(F.col("mei"), F.col("hit_identity"))).alias("mate_identity"))
    return named.join(counts, KEYS, "left").na.fill(0, ["checked_mates", "mei_mates", "tail_mates"]), judged.select(*names, "mei")


def reference_copies(candidates: DataFrame, consensus: DataFrame, contigs: DataFrame, reference: DataFrame) -> DataFrame:
    """Add reference_copy: whether a piece of the reference beside the site is of the candidate's family.

    Looked at are candidates that mates type or place, or that have mates in a tail. Where there
    is no copy, mates in the tail no longer count as looked at.
    """
    chosen = candidates.where("family is not null").where(F.col("by_mates") | F.array_contains("filters", "no_junction") | (F.col("tail_mates") > 0))
    sites = chosen.select(*KEYS, F.col("family").alias("own"), F.col("breakpoint")).join(F.broadcast(contigs.select(F.col("rank").alias("contig"), F.col("name").alias("_name"))), "contig")
    around = bases(sites, reference, "_name", F.col("breakpoint") - COPY_BESIDE, F.col("breakpoint") + COPY_BESIDE).where(F.length("window") >= PIECE)
    pieces = around.select(*KEYS, "own", F.explode(F.expr(f"transform(sequence(0, length(window) - {PIECE}, {STEP}), i -> substr(window, i + 1, {PIECE}))")).alias("piece"))
    copies = typing.hits_of(pieces, consensus, "piece").where("family = own").select(*KEYS).distinct().withColumn("_copy", F.lit(True))
    flagged = candidates.join(copies, KEYS, "left").withColumn("reference_copy", F.coalesce("_copy", F.lit(False))).drop("_copy")
    left = F.when(F.col("reference_copy"), F.col("tail_mates")).otherwise(F.lit(0))
    return flagged.withColumn("checked_mates", F.when(F.col("reference_copy"), F.col("checked_mates")).otherwise(F.col("checked_mates") - F.col("tail_mates"))).withColumn("tail_mates", left)
