"""Aggregates with fixed rules for ties, and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .positions import running_sums


#: Rows of a task where nearly every row has a key of its own.
DEALT_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Deal about ``rows`` rows by keys to as many tasks as their number asks for.

    Where there are nearly as many keys as rows, to aggregate before the shuffle would spare nothing and hold
    all of a file's keys in memory; an aggregate or window by these keys over dealt rows needs no other shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // DEALT_ROWS), *keys)


def many_counts(df: DataFrame, keys: list[str], rows: int, name: str = "n") -> DataFrame:
    """How many rows each combination of keys has, where there are nearly as many of them as rows (about ``rows``)."""
    return dealt(df, keys, rows).groupBy(*keys).agg(F.count("*").alias(name))


def smallest_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key, the smallest of equally frequent ones: mode, n.

    Counts are pre-aggregated for each key and value before the keys come together.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counted.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("mode"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(value))).alias("_b"))
    return best.select(*keys, "_b.mode", "_b.n")


def _histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))


def _middle(counted: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The lower median of each key by its distinct values and how often they occur (_n): name, n."""
    upto = running_sums(counted, keys, [value], {"_before": F.col("_n")}, totals=True)
    middle = F.expr("(_before_all - 1) div 2")
    return upto.where((F.col("_before") <= middle) & (F.col("_before") + F.col("_n") > middle)).select(*keys, F.col(value).alias(name), F.col("_before_all").alias("n"))


def lower_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The value of rank (n - 1) div 2 (from 0) of each key, from an exact histogram.

    Only distinct values are put in order, and those of one key by several tasks.
    """
    return _middle(_histogram(df, keys, value), keys, value, name)


#: Medians of so many keys are broadcast; of more keys they are copied for SALTS parts of each key's values.
BROADCAST_KEYS, SALTS = 50_000, 64


def _with_medians(counted: DataFrame, medians: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add its key's median to each value, without bringing the values of one key to one task."""
    if not keys:
        return counted.crossJoin(F.broadcast(medians))
    if medians.count() <= BROADCAST_KEYS:
        return counted.join(F.broadcast(medians), keys)
    copies = medians.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counted.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt")


def outlier_threshold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Robust threshold of integer values: n, median, mad and threshold, from median + 6 scaled deviations.

    Deviations come from the histogram of the values too, so rows are only counted.
    """
    counted = staged(_histogram(df, keys, value), "histogram")
    middle = staged(_middle(counted, keys, value, "median"), "medians")
    away = _with_medians(counted, middle.select(*keys, "median"), keys, value).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = _middle(away.groupBy(*keys, "_d").agg(F.sum("_n").alias("_n")), keys, "_d", "mad").drop("n")
    joined = middle.join(mad, keys) if keys else middle.crossJoin(mad)
    step = F.greatest(F.lit(1), F.ceil(6 * 1.4826 * F.col("mad")))
    return joined.select(*keys, "n", "median", "mad", (F.col("median") + step).cast("long").alias("threshold"))


def vote(hits: DataFrame, ballot: list[str], voter: str, candidate: str, rank: str, score: str) -> DataFrame:
    """The candidate with the greatest sum of scores: each voter counts its best score for each candidate.

    Ties go to the lower rank. Returns ballot, candidate, total and voters.
    """
    best = hits.groupBy(*ballot, candidate, rank, voter).agg(F.max(score).alias("_s"))
    sums = best.groupBy(*ballot, candidate, rank).agg(F.sum("_s").alias("total"), F.count("*").alias("voters"))
    first = F.min_by(F.struct(candidate, "total", "voters"), F.struct(-F.col("total"), F.col(rank)))
    return sums.groupBy(*ballot).agg(first.alias("_b")).select(*ballot, f"_b.{candidate}", "_b.total", "_b.voters")


def outcome_counts(df: DataFrame, reason: Column, keys: list[str] | None = None) -> DataFrame:
    """How many rows met each outcome."""
    return df.groupBy(*(keys or []), reason.alias("outcome")).agg(F.count("*").alias("n"))


def placement(signals: DataFrame, keys: list[str], position: str, is_right: Column, near: int = 20, far: int = 300) -> DataFrame:
    """Where the mates of each key put a breakpoint, and the interval it lies in.

    Mates on the right side end before it (the last of them is up), those on the left begin
    after it (the first is down). If both agree within ``near``, it lies midway; else the side
    with more mates decides, with ``far`` bases of room on its open side; ties go to the right.
    """
    p = F.col(position)
    sides = signals.groupBy(*keys).agg(F.max(F.when(is_right, p)).alias("up"), F.min(F.when(~is_right, p)).alias("down"), F.count(F.when(is_right, 1)).alias("n_up"), F.count(F.when(~is_right, 1)).alias("n_down"))
    return sides.select(*keys, *placed(near, far))


def placed(near: int, far: int) -> list[Column]:
    """breakpoint, first and last of placement, from up, down, n_up and n_down; for all null without mates."""
    both = F.col("up").isNotNull() & F.col("down").isNotNull() & (F.col("up") <= F.col("down") + near)
    by_up = F.col("up").isNotNull() & (F.col("n_up") >= F.col("n_down"))
    low, high = F.least("up", "down"), F.greatest("up", "down")

    def choose(a: Column, b: Column, c: Column) -> Column:
        return F.when(both, a).when(by_up, b).otherwise(c)

    return [
        choose(F.floor((low + high) / 2), F.col("up"), F.col("down")).cast("long").alias("breakpoint"),
        choose(low - near, F.col("up") - near, F.col("down") - far).alias("first"),
        choose(high + near, F.col("up") + far, F.col("down") + near).alias("last"),
    ]
