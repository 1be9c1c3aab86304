"""Refit of the quality score: labelled calls, leave-one-sample-out models, and what thresholds keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 60


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, all columns as strings."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def labelled(calls: DataFrame, false: DataFrame, true: DataFrame, keys: tuple[str, ...] = ("sample", "contig", "position")) -> DataFrame:
    """The calls found in one of the two tables, with label 0 (false) or 1 (true); false wins."""
    marks = false.select(*keys).distinct().withColumn("label", F.lit(0)).unionByName(true.select(*keys).distinct().withColumn("label", F.lit(1)))
    return calls.join(marks.groupBy(*keys).agg(F.min("label").alias("label")), list(keys))


def features(calls: DataFrame) -> DataFrame:
    """Add f_... columns, 0 or 1, for the evidence of each call in a report's table (strings, null for a point)."""
    n = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    support, checked = F.greatest(n("support"), F.lit(1.0)), n("checked_mates")
    found = {
        "both": F.col("left_junction").isNotNull() & F.col("right_junction").isNotNull(),
        "tail": n("polya_clips") + n("polyt_clips") > 0,
        "tsd": F.col("tsd_length").isNotNull(),
        "identity": F.col("family").isNotNull() & (n("identity") >= 0.98),
        "starts": n("distinct_starts") / support >= 0.7,
        "mei_mates": (checked > 0) & (n("mei_mates") / F.greatest(checked, F.lit(1.0)) >= 0.6),
        "ratio": F.col("signal_ratio").isNotNull() & (n("signal_ratio") >= 0.2),
        "by_mates": F.coalesce(F.col("typed_by") == "mates", F.lit(False)),
        "breakpoint_clips": n("breakpoint_clips") > 0,
        "imprecise": F.col("cipos").isNotNull(),
        "junction_clips": n("left_junction_clips") + n("right_junction_clips") >= 2,
        "many_mei": n("mei_mates") >= 8,
    }
    return calls.select("*", *[c.cast("int").alias(f"f_{k}") for k, c in found.items()])


def _ratios(feature: str) -> tuple[Column, Column]:
    share1 = (F.col(f"{feature}_1") + 1) / (F.col("n_1") + 2)
    share0 = (F.col(f"{feature}_0") + 1) / (F.col("n_0") + 2)
    return F.log10(share1 / share0), F.log10((1 - share1) / (1 - share0))


def models(df: DataFrame, names: list[str], label: str, group: str | None = None) -> DataFrame:
    """Naive-Bayes models in log10 odds: prior, and for each 0/1 feature present_ and absent_; all counts raised by one.

    With ``group`` there is a model for each of its values, fitted on all others.
    """
    of = lambda k: [F.count_if(F.col(label) == k).alias(f"n_{k}"), *[F.coalesce(F.sum(F.when(F.col(label) == k, F.col(f))), F.lit(0)).alias(f"{f}_{k}") for f in names]]
    counts = ["n_1", "n_0", *[f"{f}_{k}" for f in names for k in (0, 1)]]
    whole = df.agg(*of(0), *of(1))
    if group:
        own = df.groupBy(group).agg(*of(0), *of(1))
        total = whole.select(*[F.col(c).alias(f"all_{c}") for c in counts])
        whole = own.crossJoin(F.broadcast(total)).select(group, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in counts])  # one row
    prior = F.log10((F.col("n_1") + 1) / (F.col("n_0") + 1)).alias("prior")
    return whole.select(*([group] if group else []), prior, *[c.alias(f"{side}_{f}") for f in names for side, c in zip(("present", "absent"), _ratios(f), strict=True)])


def scored(df: DataFrame, model: DataFrame, names: list[str], group: str | None = None) -> DataFrame:
    """Add score, the log10 odds of each row; with ``group`` by the model that its group took no part in."""
    joined = df.join(model, group) if group else df.crossJoin(F.broadcast(model))  # one row
    parts = [F.when(F.col(f) == 1, F.col(f"present_{f}")).otherwise(F.col(f"absent_{f}")) for f in names]
    return joined.select(*df.columns, reduce(lambda a, b: a + b, parts, F.col("prior")).alias("score"))


def phred(score: Column) -> Column:
    """Quality of a score in log10 odds, at most MOST; halves go to the even number."""
    wrong = F.greatest(1 / (1 + F.pow(F.lit(10.0), score)), F.lit(1e-12))
    return F.least(F.bround(-10 * F.log10(wrong)), F.lit(float(MOST)))


def kept(df: DataFrame, label: str, thresholds: list[int]) -> DataFrame:
    """True and false rows of which the quality reaches each threshold, and their precision."""
    tall = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(phred(F.col("score")) >= F.col("threshold"))
    counts = tall.groupBy("threshold").agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp"))
    return counts.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))


SETS = ("tuning", "test", "related")


def split_leaks(rows: DataFrame) -> DataFrame:
    """Problems of a split (sample, family_id, set): problem, and the sample or family it is of.

    A set that isn't known; a family in both the tuning and the test set; a family with a
    related sample and none in the tuning set.
    """
    unknown = rows.where(~F.col("set").isin(*SETS) | F.col("set").isNull()).select(F.lit("unknown set").alias("problem"), F.col("sample").alias("of"))
    has = lambda s: F.count_if(F.col("set") == s)
    families = rows.groupBy("family_id").agg(has("tuning").alias("tuning"), has("test").alias("test"), has("related").alias("related"))
    both = families.where("tuning > 0 and test > 0").select(F.lit("in tuning and test").alias("problem"), F.col("family_id").alias("of"))
    alone = families.where("related > 0 and tuning = 0").select(F.lit("related without tuning").alias("problem"), F.col("family_id").alias("of"))
    return unknown.unionByName(both).unionByName(alone)


def pedigree_mismatches(rows: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Samples whose family differs from the pedigree's (individual, family; absent counts as different)."""
    known = pedigree.select(F.col("individual").alias("sample"), F.col("family").alias("pedigree_family"))
    return rows.join(known, "sample", "left").where(~F.col("family_id").eqNullSafe(F.col("pedigree_family"))).select("sample", "family_id", "pedigree_family")
