"""One-to-one matching, nearest pairs first, in rounds of joins.

Taking pairs by (distance, left, right), each if both its sides are free, gives the same matches as taking
in each round all pairs that come before every other pair of either side: none of the others
can be taken before them. Whatever a round takes leaves the rest, and at least the
first pair of all is taken, so no group of pairs ever has to come to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import ranked, with_neighbours
from ..storage import new_path, staged


def _key(keys: list[str]) -> Column:
    """The keys as one column, in which nulls are equal."""
    return F.struct(*keys) if keys else F.lit(0)


def greedy_match(pairs: DataFrame, keys: list[str], left: str, right: str, distance: str) -> DataFrame:
    """One-to-one matches of listed pairs: keys, left, right, distance. Pairs without a side or a distance don't count."""
    spark = pairs.sparkSession
    listed = pairs.select(_key(keys).alias("_k"), *keys, left, right, distance).dropna(subset=[left, right, distance])
    rest, out = staged(listed, "pairs"), new_path(spark, "matches")
    schema = rest.schema
    rest.limit(0).write.parquet(out)
    while not rest.isEmpty():
        order = F.struct(distance, left, right)
        by_left = rest.groupBy("_k", left).agg(F.min(order).alias("_o")).select("_k", "_o")
        by_right = rest.groupBy("_k", right).agg(F.min(order).alias("_o")).select("_k", "_o")
        names = [F.col(f"_k.{k}").alias(k) for k in keys]
        taken = staged(by_left.join(by_right, ["_k", "_o"]).select("_k", *names, f"_o.{left}", f"_o.{right}", f"_o.{distance}"), "taken")
        taken.write.mode("append").parquet(out)
        rest = staged(rest.join(taken, ["_k", left], "left_anti").join(taken, ["_k", right], "left_anti"), "pairs")
    return spark.read.schema(schema).parquet(out).select(*keys, left, right, distance)


_SITE = ["_k", "_at"]


def _with_mates(sites: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """Sites with the site that each would be matched with first, its distance, and whether another is as near."""
    first = points.select("_k", "_at", "_left", F.col("_rank").alias("_used"), "_name")
    named = sites.join(first, ["_k", "_at", "_left", "_used"])
    facts = F.struct("_name")
    around = with_neighbours(named, ["_k"], "_at", {"left": F.when(F.col("_left"), facts), "right": F.when(~F.col("_left"), facts)}, 64 * max(reach, 1))

    def candidate(way: str) -> Column:
        site = F.when(F.col("_left"), F.col(f"{way}_right")).otherwise(F.col(f"{way}_left"))
        away = F.abs(site["at"] - F.col("_at"))
        return F.when(away <= reach, F.struct(away.alias("distance"), site["value"]["_name"].alias("name"), site["at"].alias("at")))

    told = around.withColumn("_p", candidate("previous")).withColumn("_n", candidate("next"))
    best = F.least("_p", "_n")  # nulls don't count
    tied = F.coalesce(F.col("_p.distance") == F.col("_n.distance"), F.lit(False))
    return told.select("_k", "_at", "_left", "_n_free", "_used", best["at"].alias("_mate"), best["distance"].alias("_distance"), tied.alias("_tied")).where("_mate is not null")


def match_by_position(points: DataFrame, keys: list[str], position: str, is_left: str, name: str, reach: int, left: str, right: str) -> DataFrame:
    """One-to-one matches of left and right points at most ``reach`` apart, as greedy_match of all their pairs.

    Pairs are not listed. Points of one side at one position are one site, taken in the order of
    their names. Where both sides meet at a position they are matched there; then each round matches the sites that are
    nearest to each other (of equally near ones by names, one point at a time), and drops those that have nobody left
    within reach. Names must be distinct on each side; rows without a key or a position don't count.
    """
    spark = points.sparkSession
    known = points.where(F.col(position).isNotNull() & F.col(is_left).isNotNull()).dropna(subset=[*keys, name])
    plain = known.select(_key(keys).alias("_k"), F.col(position).cast("long").alias("_at"), F.col(is_left).alias("_left"), F.col(name).cast("long").alias("_name"))
    numbered = staged(ranked(plain, ["_k", "_at", "_left"], ["_name"], "_rank"), "points")
    sides = numbered.groupBy(*_SITE).agg(F.count_if("_left").alias("_l"), F.count_if(~F.col("_left")).alias("_r"))
    both = staged(sides, "positions")
    out = new_path(spark, "matches")
    met = F.least("_l", "_r")
    nothing = F.lit(0).cast("long")
    both.where("_l > 0 and _r > 0").select("_k", F.col("_at").alias("_left_at"), F.col("_at").alias("_right_at"), nothing.alias("_left_from"), nothing.alias("_right_from"), met.alias("_n")).write.parquet(out)
    sites = both.where("_l <> _r").select("_k", "_at", (F.col("_l") > F.col("_r")).alias("_left"), F.abs(F.col("_l") - F.col("_r")).alias("_n_free"), met.alias("_used"))
    while True:
        free = staged(_with_mates(sites, numbered, reach), "sites")
        a, b = (free.where("_left" if side == "left" else "not _left").select("_k", *[F.col(c).alias(f"_{side}{c}") for c in ("_at", "_mate", "_n_free", "_used", "_tied")]) for side in ("left", "right"))
        mutual = a.join(b, (a["_k"] == b["_k"]) & (F.col("_left_at") == F.col("_right_mate")) & (F.col("_left_mate") == F.col("_right_at"))).drop(b["_k"])
        units = F.when(F.col("_left_tied") | F.col("_right_tied"), F.lit(1).cast("long")).otherwise(F.least("_left_n_free", "_right_n_free"))
        taken = staged(mutual.select("_k", "_left_at", "_right_at", F.col("_left_used").alias("_left_from"), F.col("_right_used").alias("_right_from"), units.alias("_n")), "taken")
        if taken.isEmpty():
            break
        taken.write.mode("append").parquet(out)
        gone = taken.select("_k", F.explode(F.array("_left_at", "_right_at")).alias("_at"), F.col("_n").alias("_gone"))
        left_over = free.join(gone, _SITE, "left").withColumn("_gone", F.coalesce("_gone", nothing))
        sites = left_over.select("_k", "_at", "_left", (F.col("_n_free") - F.col("_gone")).alias("_n_free"), (F.col("_used") + F.col("_gone")).alias("_used")).where("_n_free > 0")
    each = spark.read.parquet(out).withColumn("_i", F.explode(F.sequence(nothing, F.col("_n") - 1)))
    ends = []
    for side, want in (("left", F.col("_left")), ("right", ~F.col("_left"))):
        ends.append(numbered.where(want).select(F.col("_k"), F.col("_at").alias(f"_{side}_at"), F.col("_rank").alias(f"_{side}_rank"), F.col("_name").alias(f"_{side}_name")))
    ranks = each.select("_k", "_left_at", "_right_at", (F.col("_left_from") + F.col("_i")).alias("_left_rank"), (F.col("_right_from") + F.col("_i")).alias("_right_rank"))
    named = ranks.join(ends[0], ["_k", "_left_at", "_left_rank"]).join(ends[1], ["_k", "_right_at", "_right_rank"])
    return named.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("_left_name").alias(left), F.col("_right_name").alias(right), F.abs(F.col("_left_at") - F.col("_right_at")).alias("distance"))
