"""Operators over half-open intervals of contigs.

Range joins are equi-joins on nested bins with the range as a further condition, so they are hash or
sort-merge joins and never compare all pairs of a contig, nor copy a long row to many bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import gap_clusters, with_previous_max


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1 << 20, before: str | None = None) -> DataFrame:
    """Union of intervals that overlap or touch: keys, start, end, merged (how many); with ``before`` the end of the one before, too."""
    plain = df.select(*keys, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    reach = with_previous_max(plain, keys, "start", "end", width, "_reach", ["end"])
    opened = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start"))
    # of equal intervals any may be the first, so all learn where they begin from all up to their start
    island = with_previous_max(reach.withColumn("_open", opened), keys, "start", "_open", width, "_island", None)
    return island.groupBy(*keys, F.col("_island").alias("start")).agg(F.max("end").alias("end"), F.count("*").alias("merged"), *([F.max(F.when(F.col("_open").isNotNull(), F.col("_reach"))).alias(before)] if before else []))


def covered(df: DataFrame, keys: list[str], **names: object) -> DataFrame:
    """Length that the intervals of each key cover."""
    return merge_intervals(df, keys, **names).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def _level(start: Column, end: Column) -> Column:
    """The least level whose bins, 16 ** level wide, are as long as an interval."""
    length = end - start
    return F.when(length > 1, F.length(F.hex(length - 1))).otherwise(F.when(length.isNotNull(), F.lit(0)))


def _slots(others: DataFrame, level: str, left: bool) -> Column:
    """For each level an array of the slots of a row of that level, by a subquery on the levels of the other side.

    A slot is a level, and which side is the longer one there (even: left). A row waits at its own
    level if the other side has shorter rows, and looks at the levels of the other side's longer rows. Of equal levels the left side looks.
    """
    own, opposite = (0, 1) if left else (1, 0)
    present = F.col("present")

    def of(at: Column) -> Column:
        waits = F.exists(present, lambda x: x < at if left else x <= at)
        above = F.filter(present, lambda x: x >= at if left else x > at)
        waiting = F.when(waits, F.array(at * 2 + own)).otherwise(F.array().cast("array<int>"))
        return F.concat(waiting, F.transform(above, lambda x: x * 2 + opposite))

    return others.agg(F.collect_set(level).alias("present")).select(F.transform(F.sequence(F.lit(0), F.lit(16)), of).alias("slots")).scalar()


def _placed(df: DataFrame, name: str, slots: Column) -> DataFrame:
    """A row for each slot and bin of an interval (its start, end and level): one or two bins in each slot."""
    start, end, level = (F.col(f"_{name}_{c}") for c in ("start", "end", "level"))
    slotted = df.withColumn(f"_{name}_slot", F.explode(F.get(slots, level)))
    shift = F.shiftright(f"_{name}_slot", 1) * 4
    low = F.call_function("shiftright", start, shift)
    high = F.greatest(low, F.call_function("shiftright", end - 1, shift))
    return slotted.withColumn(f"_{name}_bin", F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_range: tuple[Column, Column], right_range: tuple[Column, Column]) -> DataFrame:
    """All pairs of rows with equal keys whose half-open ranges overlap, each pair once.

    left and right must not share column names. Lengths may be as different as they like: bins are nested,
    16 times as wide from level to level. A row waits in the one or two bins that it
    touches of the level of its own length, and looks for longer rows in the bins above, of the levels that the
    other side has (at most one for each power of 16, found by a subquery). So a row has a few copies, however
    long it is. A pair that shares two bins is kept in the one where its overlap begins. Rows with a null in key or range have no pair.
    """
    sides = []
    for name, df, (start, end) in (("left", left, left_range), ("right", right, right_range)):
        ranged = df.withColumn(f"_{name}_start", start.cast("long")).withColumn(f"_{name}_end", end.cast("long"))
        sides.append(ranged.withColumn(f"_{name}_level", _level(F.col(f"_{name}_start"), F.col(f"_{name}_end"))))
    a = _placed(sides[0], "left", _slots(sides[1], "_right_level", True))
    b = _placed(sides[1], "right", _slots(sides[0], "_left_level", False))
    match = (F.col("_left_slot") == F.col("_right_slot")) & (F.col("_left_bin") == F.col("_right_bin"))
    for x, y in on:
        match = match & (F.col(x) == F.col(y))
    begins = F.call_function("shiftright", F.greatest("_left_start", "_right_start"), F.shiftright("_left_slot", 1) * 4)
    touches = (F.col("_left_start") < F.col("_right_end")) & (F.col("_right_start") < F.col("_left_end")) & (F.col("_left_bin") == begins)
    return a.join(b, match & touches).drop(*[f"_{name}_{c}" for name in ("left", "right") for c in ("start", "end", "level", "slot", "bin")])


def within_any(rows: DataFrame, regions: DataFrame, on: list[tuple[str, str]], row_range: tuple[Column, Column], region_range: tuple[Column, Column]) -> DataFrame:
    """The rows that overlap some region, each once, repeated rows as often as they are.

    Regions are merged, and each knows the end of the one before; a row is kept with the
    first region that it overlaps. A row without length lies in two regions that touch there.
    """
    keys = [f"_r{i}" for i in range(len(on))]
    cut = regions.select(*[F.col(y).alias(k) for k, (_, y) in zip(keys, on, strict=True)], region_range[0].alias("_rs"), region_range[1].alias("_re"))
    islands = merge_intervals(cut, keys, "_rs", "_re", before="_before").select(*keys, F.col("start").alias("_rs"), F.col("end").alias("_re"), "_before")
    ranged = rows.withColumn("_row_start", row_range[0])
    pairs = overlap_join(ranged, islands, [(x, k) for k, (x, _) in zip(keys, on, strict=True)], (F.col("_row_start"), row_range[1]), (F.col("_rs"), F.col("_re")))
    return pairs.where(F.col("_before").isNull() | (F.col("_before") <= F.col("_row_start"))).select(*rows.columns)


def depth_at(points: DataFrame, reads: DataFrame, on: list[tuple[str, str]], position: str, read_range: tuple[Column, Column], name: str = "depth") -> DataFrame:
    """Add to each boundary the reads that overlap the bases on both sides of it; 0 where there is none.

    The rows of points must be distinct.
    """
    at = F.col(position)
    around = (F.greatest(at - 1, F.lit(0)), at + 1)
    hits = overlap_join(points, reads, on, around, read_range).groupBy(*points.columns).agg(F.count("*").alias(name))
    match = None
    for c in points.columns:
        same = F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}"))
        match = same if match is None else match & same
    joined = points.alias("p").join(hits.alias("h"), match, "left")
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in points.columns], F.coalesce(F.col(f"h.{name}"), F.lit(0)).cast("long").alias(name))


def nearest_edge(points: DataFrame, edges: DataFrame, on: list[tuple[str, str]], position: str, edge: str, tolerance: int, name: str = "distance") -> DataFrame:
    """Distance from each row to the nearest edge within the tolerance; rows without one are left out."""
    reach = (F.col(position) - tolerance, F.col(position) + tolerance + 1)
    pairs = overlap_join(points, edges, on, reach, (F.col(edge), F.col(edge) + 1))
    return pairs.groupBy(*points.columns).agg(F.min(F.abs(F.col(position) - F.col(edge))).alias(name))


def loci(points: DataFrame, keys: list[str], position: str, gap: int = 100) -> DataFrame:
    """First and last point of each run of points whose gaps are at most ``gap``, and how many they are."""
    clustered = gap_clusters(points, keys, position, gap, [])
    return clustered.groupBy(*keys, F.col("cluster_start").alias("first")).agg(F.max(position).alias("last"), F.count("*").alias("points"))


def lift(points: DataFrame, blocks: DataFrame, contig: str, position: str) -> DataFrame:
    """Map positions through alignment blocks: adds lifted_contig and lifted, null where no block holds the position.

    blocks: source, s, e, score, chain, q_contig, q_size, strand, q_start. Of several blocks
    that of the highest score counts, then that of the first chain; on the minus strand
    positions count from the other end. The rows of points must be distinct.
    """
    at = F.col(position)
    pairs = overlap_join(points, blocks, [(contig, "source")], (at, at + 1), (F.col("s"), F.col("e")))
    inner = F.col("q_start") + at - F.col("s")
    lifted = F.when(F.col("strand") == "-", F.col("q_size") - 1 - inner).otherwise(inner)
    best = F.min_by(F.struct(F.col("q_contig").alias("lifted_contig"), lifted.alias("lifted")), F.struct(-F.col("score"), F.col("chain")))
    hits = pairs.groupBy(*points.columns).agg(best.alias("_to"))
    return points.join(hits, points.columns, "left").select(*points.columns, "_to.lifted_contig", "_to.lifted")
