"""Operators over positions along contigs: gap clusters, running values, sampling.

Work along one contig is cut into bins, so that a contig (or any key) with a large share of
all rows is spread over tasks. What one bin must know of those before it (one value) comes
from a small table with a row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import staged


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def with_previous_max(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str, ties: list[str] | None) -> DataFrame:
    """Add the greatest ``value`` of all rows before each row, by (order, ties), of the same keys.

    Without ``ties`` (None) it is that of all rows up to each row's ``order``, the row and its equals too.
    """
    df = df.withColumn("_bin", _bin(F.col(order), width))
    group = Window.partitionBy(*keys, "_bin")
    inside = group.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties is None else group.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = df.groupBy(*keys, "_bin").agg(F.max(value).alias("_top"))
    carried = by_bin.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), F.max("_top").over(earlier).alias("_carried"))
    on = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = df.withColumn("_inside", F.max(value).over(inside)).join(carried, on)
    kept = [c for c in df.columns if c != "_bin"]
    return ranked.select(*kept, F.greatest("_inside", "_carried").alias(name))


def with_neighbours(df: DataFrame, keys: list[str], position: str, values: dict[str, Column], width: int) -> DataFrame:
    """For each value add previous_<name> and next_<name>: at and value of the nearest row before and after that has one.

    A value is null for rows that don't count. The rows of a key have distinct positions.
    """
    marks = {name: F.when(value.isNotNull(), F.struct(F.col(position).alias("at"), value.alias("value"))) for name, value in values.items()}
    placed = df.withColumn("_bin", _bin(F.col(position), width)).withColumns({f"_m_{name}": mark for name, mark in marks.items()})
    # two sorts instead of a frame that looks ahead, which Spark would work out anew for each row
    ways = {"previous": (F.asc, F.max), "next": (F.desc, F.min)}
    by_bin = placed.groupBy(*keys, "_bin").agg(*[last(f"_m_{name}").alias(f"_{way}_{name}") for way, (_, last) in ways.items() for name in values])
    carried = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_bin").alias("_b")]
    inside = {}
    for way, (order, last) in ways.items():
        across = Window.partitionBy(*keys).orderBy(order("_bin")).rowsBetween(Window.unboundedPreceding, -1)
        here = Window.partitionBy(*keys, "_bin").orderBy(order(position)).rowsBetween(Window.unboundedPreceding, -1)
        carried += [last(f"_{way}_{name}").over(across).alias(f"_{way}_{name}") for name in values]
        inside |= {f"{way}_{name}": F.last(f"_m_{name}", ignorenulls=True).over(here) for name in values}
    on = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = placed.withColumns(inside).join(by_bin.select(*carried), on)
    return joined.select(*df.columns, *[F.coalesce(c, f"_{c}").alias(c) for c in inside])


def gap_clusters(df: DataFrame, keys: list[str], position: str, window: int, ties: list[str], width: int | None = None, name: str = "cluster_start") -> DataFrame:
    """Add the first position of each row's cluster.

    A new cluster begins where the gap to the position before is larger than ``window``. The
    pair of keys and first position names a cluster. Of rows with equal positions and ties any may be the first.
    """
    width = width or 64 * max(window, 1)
    placed = with_previous_max(df, keys, position, position, width, "_before", ties)
    start = F.when(F.col("_before").isNull() | (F.col(position) - F.col("_before") > window), F.col(position))
    marked = placed.withColumn("_start", start)
    return with_previous_max(marked, keys, position, "_start", width, name, None).drop("_before", "_start")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """Add, for each of ``sums``, what the rows before have of it; with ``totals`` also what all rows of the key have, as <name>_all.

    The order within a key leaves no ties. Rows are dealt by ranges of key and order, so that a key with very many
    of them is summed by several tasks; each learns what comes before from a small table with a row for each range and key in it.
    """
    parts = df.withColumns({f"_v_{name}": value for name, value in sums.items()}).repartitionByRange(*keys, *order)
    dealt = staged(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{name}").alias(f"_here_{name}") for name in sums])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_here_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums]
    whole = [F.sum(f"_here_{name}").over(group).alias(f"_all_{name}") for name in sums]
    known = sizes.select(*[F.col(k).alias(f"_range_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_range"), *offsets, *whole)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("_part") == F.col("_range")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_range_key{i}"))
    joined = dealt.withColumns({f"_inside_{name}": F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)) for name in sums}).join(known, on)
    out = [(F.col(f"_before_{name}") + F.col(f"_inside_{name}")).alias(name) for name in sums]
    return joined.select(*df.columns, *out, *([F.col(f"_all_{name}").alias(f"{name}_all") for name in sums] if totals else []))


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Number the rows of each key from 0 by an order that leaves no ties, and add the key's number of rows, as running_sums."""
    numbered = running_sums(df, keys, order, {"_rank": F.lit(1).cast("long")}, totals=size is not None)
    return numbered.select(*df.columns, F.col("_rank").alias(rank), *([F.col("_rank_all").alias(size)] if size else []))


def even_sample(df: DataFrame, keys: list[str], order: list[str], most: int = 40) -> DataFrame:
    """At most ``most`` rows of each key, spread evenly over the order (which leaves no ties)."""
    numbered = ranked(df, keys, order, "_rank", "_n")
    step = F.expr(f"(_rank * {most}) div _n")
    before = F.expr(f"((_rank - 1) * {most}) div _n")
    return numbered.where((F.col("_n") <= most) | (F.col("_rank") == 0) | (step != before)).drop("_rank", "_n")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def best_boundary(votes: DataFrame, keys: list[str], boundary: str, estimate: str, least: int = 2) -> DataFrame:
    """For each key the boundary with most votes (``least`` at least); ties go to that nearest the estimate, then the smaller."""
    counted = votes.groupBy(*keys, boundary).agg(F.count("*").alias("votes"), F.min(estimate).alias("_estimate")).where(F.col("votes") >= least)
    rank = F.struct(-F.col("votes"), F.abs(F.col(boundary) - F.col("_estimate")), F.col(boundary))
    best = counted.groupBy(*keys).agg(F.min_by(F.struct(boundary, "votes"), rank).alias("_best"))
    return best.select(*keys, F.col(f"_best.{boundary}").alias(boundary), "_best.votes")


def densest_band(seeds: DataFrame, keys: list[str], diagonal: str, width: int = 20) -> DataFrame:
    """The band of diagonals no wider than ``width`` with most seeds: seeds, first and last; the first of equal bands."""
    frame = Window.partitionBy(*keys).orderBy(diagonal).rangeBetween(-width, 0)
    spans = seeds.select(*keys, diagonal, F.count("*").over(frame).alias("seeds"), F.min(diagonal).over(frame).alias("first"))
    best = F.min_by(F.struct("seeds", "first", F.col(diagonal).alias("last")), F.struct(-F.col("seeds"), F.col(diagonal)))
    return spans.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.seeds", "_b.first", "_b.last")
