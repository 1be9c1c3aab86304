"""The scan: reads and targets in, candidates out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options, examples
from ..sources.text import bases
from ..storage import staged
from . import candidates as ca
from . import extract, junctions, mates, regions, typing


class Found(NamedTuple):
    """candidates in cluster order by (contig, cluster_start); their signals; and what the scan counted.

    outcomes: reads by outcome; sizes: the insert sizes (one row); stages: candidates that were
    found, passed, or met each filter.
    """

    candidates: DataFrame
    signals: DataFrame
    outcomes: DataFrame
    sizes: DataFrame
    stages: DataFrame


def run(reads: DataFrame, contigs: DataFrame, probes: DataFrame, options: Options | None = None, consensus: DataFrame | None = None, reference: DataFrame | None = None) -> Found:
    """Candidates of insertions in the scan regions, with their signals and counts.

    reads as from sources.text.sam_reads, contigs from its header, probes as from BED,
    consensus and reference (chunks) as from FASTA. Only candidates that pass stay, unless the
    options keep filtered ones; those of low support go always. Without consensus nothing is
    typed, so options must ask for no typed clips. Without reference mapped mates, tandem
    repeats, copies beside a site and junction contigs aren't looked at.
    """
    options = options or Options()
    if consensus is None and options.calling.min_typed_clips > 0:
        raise ValueError("without consensus sequences no clip is typed: set min_typed_clips to 0")
    unknown = regions.unknown_probes(probes, contigs).groupBy("contig").agg(F.max("restyled").alias("restyled")).orderBy("contig").limit(6).collect()
    if unknown:
        style = "; it has them under the other style of names" if unknown[0]["restyled"] else ""
        raise ValueError(f"the header lacks contigs of the targets: {examples([r['contig'] for r in unknown])}{style}")
    if options.calling.profile == "exome" and reference is None and not options.allow_no_reference:
        raise ValueError("the profile exome needs the reference: give it, take the profile discovery, or set allow_no_reference")
    targets = regions.restrict(regions.scan_regions(probes, contigs, options.padding), contigs, options.region)
    if reference is not None:
        scanned = contigs.join(targets.select(F.col("contig").alias("rank")), "rank", "left_semi").select(F.col("name").alias("contig"))
        changed = regions.changed_contigs(contigs, reference, probes, scanned).orderBy("name").limit(1).collect()
        if changed:
            said = {"missing": "lacks contig {name}", "length": "has {bases} bases of contig {name}, and the header {length}", "digest": "has another sequence of contig {name} than the header tells"}
            raise ValueError(f"the reference {said[changed[0]['reason']].format(**changed[0].asDict())}")
    found, outcomes, sizes = extract.signals(reads, targets, options.reading, consensus)
    rows = staged(ca.clustered(staged(found, "signals"), options.calling.window), "clustered")
    kept = staged(ca.profiles(rows, options.calling).where(F.col("support") >= options.calling.min_support), "candidates")
    ranked = probes.join(F.broadcast(contigs.select(F.col("rank"), F.col("name").alias("_name"))), F.col("contig") == F.col("_name")).select(F.col("rank").alias("contig"), "start", "end")
    edges = ca.at_probe_edges(rows, ranked, options.calling.probe_edge_tolerance)
    deep = ca.with_depth(kept, reads, options.reading).join(edges, ca.KEYS, "left").na.fill(False, ["only_edges"])
    rows = staged(rows.join(kept.select(*ca.KEYS), ca.KEYS, "left_semi"), "candidate-signals")

    told = None
    if consensus is not None:
        clips = staged(typing.junction_clips(rows, deep, ca.KEYS, ca.NEAR_JUNCTION), "junction-clips")
        if reference is not None:
            deep = junctions.tandem_repeats(clips, deep, contigs, reference)
        typed = deep.join(typing.type_clips(clips, consensus, ca.KEYS), ca.KEYS, "left")
        typed = staged(ca.with_later(typed).na.fill(0, ["typed_clips", "short_typed_clips"]).na.fill(False, ["by_mates"]), "typed-by-clips")
        deep, told = mates.check(rows, typed.drop("checked_mates", "mei_mates", "tail_mates", "mate_identity"), reads, consensus, contigs, reference)
        moved = staged(junctions.located(deep, reads, options.reading), "located")
        again = ca.with_depth(moved.where("moved").drop("depth", "signal_ratio"), reads, options.reading)
        deep = moved.where("not moved").unionByName(again).drop("moved")
        if reference is not None:
            deep = staged(mates.reference_copies(deep.drop("reference_copy"), consensus, contigs, reference), "copies")
            deep = junctions.assembled(deep, reads, contigs, reference, consensus, options.reading)
    elif reference is not None:
        clips = typing.junction_clips(rows, deep, ca.KEYS, ca.NEAR_JUNCTION)
        deep = junctions.tandem_repeats(clips, deep, contigs, reference)

    rated = staged(ca.judged(deep, options.calling), "judged")
    stages = rated.select(F.explode(F.concat(F.array(F.lit("found"), F.when(F.size("filters") == 0, F.lit("passed")).otherwise(F.lit("filtered"))), "filters")).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))
    if not options.calling.keep_filtered:
        rated = rated.where(F.size("filters") == 0)
    named = F.broadcast(contigs.select(F.col("rank").alias("contig"), F.col("name").alias("contig_name")))
    called = ca.genotyped(rated, reads, options.reading).join(named, "contig")
    if reference is not None:
        at = F.greatest(F.col("breakpoint"), F.lit(1)) - 1
        places = called.select("contig_name", at.alias("_at")).distinct()
        based = bases(places, reference, "contig_name", F.col("_at"), F.col("_at") + 1, "ref_base")
        called = called.withColumn("_at", at).join(based, ["contig_name", "_at"], "left").drop("_at")
        called = called.withColumn("ref_base", F.when(F.col("ref_base").rlike("^[A-Za-z]$"), F.upper("ref_base")))
    if told is not None:
        names = [*ca.KEYS, "read", "first_segment", "kind", "position", "side"]
        rows = rows.join(told, names, "left")
    return Found(staged(called, "called"), rows, outcomes, sizes, stages)


def scan(reads: DataFrame, contigs: DataFrame, probes: DataFrame, options: Options | None = None, consensus: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """The candidates of run."""
    return run(reads, contigs, probes, options, consensus, reference).candidates
