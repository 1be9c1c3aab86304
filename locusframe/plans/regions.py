"""Capture targets: probes padded, clamped and merged into scan regions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..options import parse_region


def scan_regions(probes: DataFrame, contigs: DataFrame, padding: int = 300) -> DataFrame:
    """Disjoint regions by contig rank: contig, start, end, merged (probes in it)."""
    known = contigs.select(F.col("rank"), F.col("name").alias("_name"), "length")
    placed = probes.join(F.broadcast(known), F.col("contig") == F.col("_name"))  # contigs of a header
    padded = placed.select(F.col("rank").alias("contig"), F.greatest(F.col("start") - padding, F.lit(0)).alias("start"), F.least(F.col("end") + padding, F.col("length")).alias("end"))
    return iv.merge_intervals(padded, ["contig"])


def restrict(regions: DataFrame, contigs: DataFrame, region: str | None) -> DataFrame:
    """The parts of the regions inside one of the user's."""
    if region is None:
        return regions
    name, start, end = parse_region(region)
    cut = regions.join(contigs.where(F.col("name") == name).select(F.col("rank").alias("contig")), "contig", "left_semi")
    low = F.greatest("start", F.lit(start or 0))
    high = F.least("end", F.lit(end)) if end is not None else F.col("end")
    return cut.select("contig", low.alias("start"), high.alias("end"), "merged").where("start < end")


def unknown_probes(probes: DataFrame, contigs: DataFrame) -> DataFrame:
    """Probes on contigs that the header lacks; ``restyled`` tells whether it has them under the other style of names."""
    other = F.when(F.col("contig").startswith("chr"), F.regexp_replace(F.regexp_replace("contig", "^chrM$", "chrMT"), "^chr", "")).otherwise(F.concat(F.lit("chr"), F.regexp_replace("contig", "^MT$", "M")))
    missing = probes.join(contigs, probes["contig"] == contigs["name"], "left_anti")
    return missing.withColumn("_other", other).join(F.broadcast(contigs.select(F.col("name").alias("_found"))), F.col("_other") == F.col("_found"), "left").withColumn("restyled", F.col("_found").isNotNull()).drop("_other", "_found")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and MD5 of each contig from its chunks in order; one chunk is held at a time."""
    name, digest, n = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"contig": [name], "bases": [n], "digest": [digest.hexdigest()]})

    for batch in batches:
        for contig, seq in zip(batch["contig"].to_pylist(), batch["seq"].to_pylist(), strict=True):
            if contig != name:
                if digest:
                    yield out()
                name, digest, n = contig, hashlib.md5(usedforsecurity=False), 0
            digest.update(seq.upper().encode())
            n += len(seq)
    if digest:
        yield out()


def changed_contigs(contigs: DataFrame, reference: DataFrame, needed: DataFrame | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """Contigs of the header that the reference's chunks (contig, chunk, seq) don't have as they are, and why: name, reason, length, bases.

    reason: missing or length, of the contigs ``needed``; else digest (if the header has an MD5), of
    those ``scanned``. Both have a column contig; without them all contigs of the header count. Only the sequences of scanned contigs are digested.
    """

    def those(names: DataFrame | None) -> DataFrame:
        return contigs if names is None else contigs.join(names.select(F.col("contig").alias("name")), "name", "left_semi")

    bases = reference.groupBy("contig").agg(F.sum(F.length("seq")).alias("bases"))
    sized = those(needed).select("name", "length").join(bases, F.col("name") == F.col("contig"), "left")
    wrong = sized.where("bases is null or bases <> length").select("name", F.when(F.col("bases").isNull(), F.lit("missing")).otherwise(F.lit("length")).alias("reason"), "length", "bases")
    told = those(scanned).where("m5 is not null").select("name", "length", "m5")
    chunks = reference.join(told.select(F.col("name").alias("contig")), "contig", "left_semi")
    ordered = chunks.repartition("contig").sortWithinPartitions("contig", "chunk").select("contig", "seq")
    whole = ordered.mapInArrow(_digests, "contig string, bases long, digest string")
    other = told.join(whole, F.col("name") == F.col("contig")).where("m5 <> digest").select("name", F.lit("digest").alias("reason"), "length", "bases")
    return wrong.unionByName(other.join(wrong.select("name"), "name", "left_anti"))


def derived_targets(targets: DataFrame, blocks: DataFrame, trim: int = 50) -> DataFrame:
    """Targets (contig, start, end) lifted through alignment blocks where both ends come to one contig in one piece.

    Lifted intervals longer than twice ``trim`` lose it at both ends. Blocks as of sources.text.chain.
    """
    ends = targets.select("contig", "start", "end", F.explode(F.array(F.col("start"), F.col("end") - 1)).alias("at")).distinct()
    lifted = iv.lift(ends, blocks, "contig", "at").where("lifted is not null")
    whole = lifted.groupBy("contig", "start", "end").agg(F.count_distinct("lifted_contig").alias("places"), F.min("lifted_contig").alias("to"), F.min("lifted").alias("low"), (F.max("lifted") + 1).alias("high"), F.count("*").alias("n"))
    kept = whole.where((F.col("places") == 1) & (F.col("high") - F.col("low") == F.col("end") - F.col("start")))
    long = F.col("high") - F.col("low") > 2 * trim
    return kept.select(F.col("to").alias("contig"), F.when(long, F.col("low") + trim).otherwise(F.col("low")).alias("start"), F.when(long, F.col("high") - trim).otherwise(F.col("high")).alias("end")).orderBy("contig", "start")
