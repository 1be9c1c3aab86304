"""Evaluation of calls against a truth: rates, AUC, naive Bayes, exact bounds, resampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import ranked, running_sums
from ..storage import staged


def rates(calls: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    """True and false positives, false negatives, precision and recall (null where nothing counts)."""
    counts = calls.groupBy(*(keys or [])).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    tp = F.col("tp").cast("double")
    return counts.withColumn("precision", tp / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", tp / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half.

    Only distinct scores are put in order, each with its two counts, and those of one key by several tasks.
    """
    keys = keys or []
    by_score = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    placed = running_sums(by_score, keys, [score], {"_below": F.col("_n")})
    wins = placed.withColumn("_w", F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    return wins.groupBy(*keys).agg((F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc"))


def naive_bayes(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """log10 ratios of each 0/1 feature's presence and absence between the labels, counts raised by one."""
    wide = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in features])
    tall = wide.unpivot([label, "n"], features, "feature", "present")
    of = lambda c, k: F.max(F.when(F.col(label) == k, F.col(c)))
    both = tall.groupBy("feature").agg(of("present", 1).alias("p1"), of("n", 1).alias("n1"), of("present", 0).alias("p0"), of("n", 0).alias("n0"))
    share1, share0 = (F.col("p1") + 1) / (F.col("n1") + 2), (F.col("p0") + 1) / (F.col("n0") + 2)
    return both.select("feature", F.log10(share1 / share0).alias("present"), F.log10((1 - share1) / (1 - share0)).alias("absent"))


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for j in range(100 + int(4 * math.sqrt(a + b)), 0, -1):  # from the innermost term outwards
        m, odd = divmod(j, 2)
        top = -(a + m) * (a + b + m) if odd else m * (b - m)
        value = 1 + top * x / ((a + j - 1) * (a + j)) / value
    return front / value


def lower_bound(successes: int, trials: int, level: float = 0.95) -> float:
    """Exact one-sided (Clopper-Pearson) lower bound of a share: a quantile of the beta distribution.

    It is the share at which so many successes or more have the probability 1 - level.
    """
    if not successes:
        return 0.0
    a, b, inside, outside = successes, trials - successes + 1, 0.0, 1.0
    while outside - inside > 1e-12:
        middle = (inside + outside) / 2
        if _beta_share(middle, a, b) < 1 - level:
            inside = middle
        else:
            outside = middle
    return inside


def with_lower_bound(df: DataFrame, successes: str, trials: str, level: float = 0.95) -> DataFrame:
    """Add lower_bound. Each distinct pair of counts is worked out once for each batch."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], float] = {}
        out = []
        for pair in zip(k.tolist(), n.tolist(), strict=True):
            if pair not in known:
                known[pair] = lower_bound(int(pair[0]), int(pair[1]), level)
            out.append(known[pair])
        return pd.Series(out)

    return df.withColumn("lower_bound", bound(F.col(successes).cast("long"), F.col(trials).cast("long")))


#: Weights of few groups are broadcast up to so many rows; beyond, both sides of the join are sorted.
BROADCAST_WEIGHTS = 200_000

#: Draws that a task makes.
DRAWS = 1_000_000


def bootstrap(df: DataFrame, first: str, second: str | None, hit: str, total: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """2.5 and 97.5 percentiles of sum(hit) / sum(total), with one or both groupings drawn anew and weights multiplied.

    In each round as many groups are drawn, with replacement, as there are; a group weighs as
    often as it is drawn. Draws come from a hash of the seed, round and number of the draw, so
    all tasks agree on them, and the same input gives the same interval. Cells meet the draws of the
    first grouping by the group alone and are summed by round and second group at once, so no row of a
    cell and round is shuffled before.
    """
    groups = [g for g in (first, second) if g]
    weighed = staged(df.groupBy(*groups).agg(F.sum(hit).alias("_h"), F.sum(total).alias("_t")), "cells")
    numbered = [staged(ranked(weighed.select(g).distinct(), [], [g], "_at"), "groups") for g in groups]
    for k, g in enumerate(groups):
        n = numbered[k].count()
        dealt = numbered[k].repartition(1 + n * rounds // DRAWS, "_at")
        draws = dealt.select(F.col("_at").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round"))
        taken = F.pmod(F.xxhash64(F.lit(seed * 2 + k), "_round", "_draw"), F.lit(max(n, 1)))
        times = draws.groupBy("_round", taken.alias("_at")).agg(F.count("*").alias("_times"))
        # Spark takes the rows of all rounds for one, and would broadcast either side of these joins
        weights = times.join(numbered[k].hint("merge"), "_at").select("_round", g, "_times")
        weights = F.broadcast(weights) if n * rounds <= BROADCAST_WEIGHTS else weights.hint("merge")
        drawn = weighed.join(weights, ["_round", g] if k else [g])
        weighed = drawn.groupBy("_round", *groups[k + 1 :]).agg(*[F.sum(F.col("_times") * F.col(c)).alias(c) for c in ("_h", "_t")])
    shares = weighed.select((F.col("_h") / F.nullif("_t", F.lit(0))).alias("_share"))
    ordered = shares.agg(F.array_sort(F.collect_list("_share")).alias("s"))  # one number for each round
    at = lambda q: F.get("s", F.least(F.floor(F.size("s") * q), F.size("s") - 1).cast("int"))
    return ordered.select(at(0.025).alias("low"), at(0.975).alias("high"), F.size("s").cast("long").alias("rounds"))
