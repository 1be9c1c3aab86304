"""Calls against a truth: matches, statuses, rates by level, tolerance and stratum, loci and units.

calls: sample, call, contig, points (array of positions), family (null if untyped), passes,
qual, confidence, genotype, imprecise. truth: id, contig, pos, family. genotypes: id, sample,
genotype (phased, such as 0|1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.positions import gap_clusters
from ..storage import staged
from .matching import greedy_match
from .metrics import with_lower_bound

FALSE = ("fp", "wrong_family", "duplicate")
TIERS = ("high", "medium", "low")
#: Truths and false calls of all samples no farther apart are one locus.
LOCUS_GAP = 100


def carries(genotype: Column) -> Column:
    """Whether some haplotype has the insertion; a missing genotype has not."""
    return F.coalesce(F.array_contains(F.split(genotype, r"\|"), "1"), F.lit(False))


def missing(genotype: Column) -> Column:
    """Whether one of the two haplotypes is unknown."""
    return F.coalesce(F.array_contains(F.slice(F.split(genotype, r"\|"), 1, 2), "."), F.lit(False))


def unphased(genotype: Column) -> Column:
    """0/1 or 1/1."""
    both = F.slice(F.split(genotype, r"\|"), 1, 2)
    return F.when((F.size(both) == 2) & F.forall(both, lambda x: x == "1"), F.lit("1/1")).otherwise(F.lit("0/1"))


def same_family(called: Column, true: Column) -> Column:
    """An untyped call, and a truth of another family than the three, agree with all."""
    return called.isNull() | (true == "other") | F.coalesce(called == true, F.lit(False))


def passing(calls: DataFrame, least: float | None = None) -> DataFrame:
    """The calls that pass, with a quality of ``least`` or more if it is given."""
    return calls.where("passes") if least is None else calls.where(F.col("passes") & (F.col("qual") >= least))


def labels(value: Column, edges: list[int], unit: str = "") -> Column:
    """Name of the half-open bin, between the edges, that holds a value."""
    out = F.when(value < edges[0], F.lit(f"< {edges[0]}{unit}"))
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(value < high, F.lit(f"{low}-{high - 1}{unit}"))
    return out.otherwise(F.lit(f">= {edges[-1]}{unit}"))


def in_targets(points: DataFrame, targets: DataFrame, contig: str, position: str) -> DataFrame:
    """The rows of which the boundary lies in a target (contig, start, end), its end included."""
    cut = targets.select(F.col("contig").alias("_t"), "start", "end")
    at = F.col(position)
    return iv.within_any(points, cut, [(contig, "_t")], (at, at + 1), (F.col("start"), F.col("end") + 1))


def target_distance(points: DataFrame, targets: DataFrame, contig: str, position: str, reach: int, name: str = "distance") -> DataFrame:
    """Add the distance of each boundary to the nearest target: 0 inside and at its ends, null beyond ``reach``.

    The rows must be distinct.
    """
    cut = targets.select(F.col("contig").alias("_t"), F.col("start").alias("_ts"), F.col("end").alias("_te"))
    at = F.col(position)
    pairs = iv.overlap_join(points, cut, [(contig, "_t")], (at - reach, at + reach + 1), (F.col("_ts"), F.col("_te") + 1))
    away = F.greatest(F.lit(0), F.col("_ts") - at, at - F.col("_te"))
    near = pairs.groupBy(*points.columns).agg(F.min(away).alias(name)).where(F.col(name) <= reach)
    match = None
    for c in points.columns:
        same = F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}"))
        match = same if match is None else match & same
    return points.alias("p").join(near.alias("n"), match, "left").select("p.*", F.col(f"n.{name}").alias(name))


def near(calls: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of a call and a truth within the tolerance of some point of the call: sample, call, id, distance."""
    at = calls.select("sample", "call", F.col("contig").alias("_c"), F.explode("points").alias("_at"))
    true = truth.select("id", F.col("contig").alias("_tc"), "pos")
    reach = (F.col("_at") - tolerance, F.col("_at") + tolerance + 1)
    pairs = iv.overlap_join(at, true, [("_c", "_tc")], reach, (F.col("pos"), F.col("pos") + 1))
    return pairs.groupBy("sample", "call", "id").agg(F.min(F.abs(F.col("_at") - F.col("pos"))).alias("distance"))


def _judged(calls: DataFrame, pairs: DataFrame, truth: DataFrame, genotypes: DataFrame, cases: list[str]) -> DataFrame:
    """Calls with their statuses in each case: ``calls`` and ``pairs`` (of sample, call, id, distance) have the columns ``cases``.

    All cases are matched at once, each apart from the others.
    """
    at = [*cases, "sample", "call"]
    told_pairs = staged(pairs.join(genotypes, ["id", "sample"], "left"), "near")
    own = told_pairs.where(carries(F.col("genotype")))
    matched = greedy_match(own, [*cases, "sample"], "call", "id", "distance").select(*at, F.col("id").alias("matched"))
    anyone = genotypes.groupBy("id").agg(F.max(carries(F.col("genotype"))).alias("_any"))
    told = told_pairs.join(anyone, "id", "left").groupBy(*at).agg(
        F.max(carries(F.col("genotype"))).alias("_own"), F.max(missing(F.col("genotype"))).alias("_missing"), F.max(F.coalesce("_any", F.lit(False))).alias("_others")
    )
    known = truth.select(F.col("id").alias("matched"), F.col("family").alias("_family")).join(genotypes.select(F.col("id").alias("matched"), "sample", F.col("genotype").alias("genotype_of_truth")), "matched")
    rows = calls.join(told, at, "left").join(matched, at, "left").join(known, ["sample", "matched"], "left")
    left = F.when(F.col("_own"), F.lit("duplicate")).when(F.col("_missing"), F.lit("unknown")).when(F.col("_others"), F.lit("other_sample")).otherwise(F.lit("fp"))
    status = F.when(F.col("matched").isNotNull(), F.when(same_family(F.col("family"), F.col("_family")), F.lit("tp")).otherwise(F.lit("wrong_family"))).otherwise(left)
    return rows.select(*calls.columns, status.alias("status"), F.col("matched").alias("id"), "genotype_of_truth")


def statuses(calls: DataFrame, truth: DataFrame, genotypes: DataFrame, tolerance: int = 20) -> DataFrame:
    """The calls with status, id (the truth that a call is matched with, or null) and genotype_of_truth.

    Pairs of a call and a truth that the sample carries are taken closest first, each side
    once: tp, or wrong_family. Other calls are duplicate near a truth of their sample; unknown
    near one that their sample isn't genotyped at; other_sample near one that another carries;
    else fp.
    """
    return _judged(calls, near(calls, truth, tolerance), truth, genotypes, [])


def carried(truth: DataFrame, genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Carrier pairs: sample and the columns of the truths that it carries."""
    have = genotypes.join(samples.select("sample").distinct(), "sample", "left_semi").where(carries(F.col("genotype")))
    return truth.join(have.select("id", "sample"), "id")


def summary(judged: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of calls by status and of carrier pairs (``pairs``: keys and id), precision and recall for each key.

    Precision is of the calls that are true or false; recall counts truths that a call of the
    right family is matched with. Calls of each confidence are counted apart.
    """
    counts = judged.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("tp", "fp", "wrong_family", "duplicate", "other_sample", "unknown")],
        F.count_if(F.col("status").isin(*FALSE)).alias("false"),
        F.count_distinct(F.when(F.col("status") == "tp", F.struct("sample", "id"))).alias("found"),
        *[c for t in TIERS for c in (F.count_if((F.col("confidence") == t) & (F.col("status") == "tp")).alias(f"tp_{t}"), F.count_if(F.col("confidence") == t).alias(f"calls_{t}"))],
    )
    total = pairs.groupBy(*keys).agg(F.count("*").alias("truth"))
    both = total.join(counts, keys, "full_outer") if keys else total.crossJoin(counts)  # one row each
    filled = both.na.fill(0)
    share = lambda a, b: F.col(a) / F.nullif(b.cast("double"), F.lit(0.0))
    return filled.withColumn("precision", share("tp", F.col("tp") + F.col("false"))).withColumn("recall", share("found", F.col("truth")))


def by_level(calls: DataFrame, truth: DataFrame, genotypes: DataFrame, thresholds: list[float], tolerance: int = 20) -> DataFrame:
    """Statuses at each level: any (all calls), PASS, and QUAL>=q for each threshold; adds level.

    A call is listed at each level it reaches; what is near it is looked for once.
    """
    passes = [F.when(F.col("passes") & (F.col("qual") >= q), F.lit(f"QUAL>={q:g}")) for q in thresholds]
    levels = F.array_compact(F.array(F.lit("any"), F.when(F.col("passes"), F.lit("PASS")), *passes))
    tall = calls.withColumn("level", F.explode(levels))
    pairs = near(calls, truth, tolerance).join(tall.select("sample", "call", "level"), ["sample", "call"])
    return _judged(tall, pairs, truth, genotypes, ["level"])


def by_tolerance(calls: DataFrame, truth: DataFrame, genotypes: DataFrame, tolerances: list[int]) -> DataFrame:
    """Calls that pass at each tolerance, all and precise and imprecise ones apart: counts and precision; recall of all.

    What is near a call is looked for once, at the widest tolerance.
    """
    pairs = carried(truth, genotypes, calls).agg(F.count("*").alias("truth"))
    good = passing(calls)
    each = F.explode(F.array(*map(F.lit, tolerances)))
    close = near(good, truth, max(tolerances)).withColumn("tolerance", each).where("distance <= tolerance")
    judged = _judged(good.withColumn("tolerance", each), close, truth, genotypes, ["tolerance"])
    out = judged.withColumn("kind", F.explode(F.array(F.lit("all"), F.when(F.col("imprecise"), F.lit("imprecise")).otherwise(F.lit("precise")))))
    counts = out.groupBy("tolerance", "kind").agg(F.count("*").alias("calls"), *[F.count_if(F.col("status") == s).alias(s) for s in ("tp", "wrong_family", "duplicate")], F.count_if(F.col("status").isin(*FALSE)).alias("false"), F.count_distinct(F.when(F.col("status") == "tp", F.struct("sample", "id"))).alias("found"))
    joined = counts.crossJoin(F.broadcast(pairs))  # one row
    precise = F.col("tp") / F.nullif((F.col("tp") + F.col("false")).cast("double"), F.lit(0.0))
    return joined.select("tolerance", "kind", "calls", "tp", "false", "wrong_family", "duplicate", precise.alias("precision"), F.when(F.col("kind") == "all", F.col("found") / F.nullif(F.col("truth").cast("double"), F.lit(0.0))).alias("recall"))


def loci(judged: DataFrame, pairs: DataFrame) -> DataFrame:
    """contig, position and locus of the carried truths and of the false calls of all samples, clustered by gaps."""
    false = judged.where(F.col("status").isin(*FALSE)).select("contig", F.array_min("points").alias("position"))
    points = pairs.select("contig", F.col("pos").alias("position")).unionByName(false).distinct()
    return gap_clusters(points, ["contig"], "position", LOCUS_GAP, [], name="locus")


def outcomes(judged: DataFrame, pairs: DataFrame, at: DataFrame) -> DataFrame:
    """tp, false and fn of each sample and locus (as of loci): a true call counts at the locus of its truth."""
    hit = judged.where("status = 'tp'").select("sample", "id").distinct().withColumn("_hit", F.lit(1))
    true = pairs.join(hit, ["sample", "id"], "left").select("sample", "contig", F.col("pos").alias("position"), F.coalesce("_hit", F.lit(0)).alias("tp"), F.lit(0).alias("false"), (1 - F.coalesce("_hit", F.lit(0))).alias("fn"))
    false = judged.where(F.col("status").isin(*FALSE)).select("sample", "contig", F.array_min("points").alias("position"), F.lit(0).alias("tp"), F.lit(1).alias("false"), F.lit(0).alias("fn"))
    both = true.unionByName(false).join(at, ["contig", "position"])
    return both.groupBy("sample", "contig", "locus").agg(*[F.sum(c).alias(c) for c in ("tp", "false", "fn")])


def units(judged: DataFrame, pairs: DataFrame, at: DataFrame) -> DataFrame:
    """One row: carrier pairs, sites, sites found in some and in every carrier, false calls and their loci."""
    hit = judged.where("status = 'tp'").select("sample", "id").distinct().withColumn("_hit", F.lit(True))
    by_site = pairs.join(hit, ["sample", "id"], "left").groupBy("id").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    sites = by_site.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("sites"), F.count_if(F.col("hits") > 0).alias("found_in_some"), F.count_if(F.col("hits") == F.col("n")).alias("found_in_every"))
    false = judged.where(F.col("status").isin(*FALSE)).select("contig", F.array_min("points").alias("position")).join(at, ["contig", "position"])
    return sites.crossJoin(false.agg(F.count("*").alias("false_calls"), F.count_distinct("contig", "locus").alias("false_loci")))  # one row each


def by_stratum(judged: DataFrame, pairs: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Recall of carrier pairs in each stratum, with its exact lower bound: stratum, name, found, total, recall, lower_bound.

    strata: names by stratum, over the columns of pairs; a null name leaves a pair out.
    """
    hit = judged.where("status = 'tp'").select("sample", "id").distinct().withColumn("_hit", F.lit(1))
    names = F.array(*[F.struct(F.lit(k).alias("stratum"), v.cast("string").alias("name")) for k, v in strata.items()])
    tall = pairs.join(hit, ["sample", "id"], "left").select("_hit", F.inline(names)).where("name is not null")
    counts = tall.groupBy("stratum", "name").agg(F.count("_hit").alias("found"), F.count("*").alias("total"))
    return with_lower_bound(counts.withColumn("recall", F.col("found") / F.col("total")), "found", "total")


def genotype_counts(judged: DataFrame) -> DataFrame:
    """True calls by the genotype of the truth and the one called; calls without one are left out."""
    told = judged.where("status = 'tp' and genotype is not null")
    return told.groupBy(unphased(F.col("genotype_of_truth")).alias("true"), F.col("genotype").alias("called")).agg(F.count("*").alias("n"))


def false_rows(judged: DataFrame) -> DataFrame:
    """Calls that are false, with their status: as written to a table of false positives."""
    return judged.where(F.col("status").isin(*FALSE)).drop("id", "genotype_of_truth")


def true_rows(judged: DataFrame) -> DataFrame:
    """Calls that aren't false, with their status and the truth's genotype (0/1 or 1/1, a point without a match)."""
    kept = judged.where(~F.col("status").isin(*FALSE))
    told = F.when(F.col("id").isNotNull(), unphased(F.col("genotype_of_truth"))).otherwise(F.lit("."))
    return kept.withColumn("truth_genotype", told).drop("id", "genotype_of_truth")


def missed_rows(judged: DataFrame, pairs: DataFrame, calls: DataFrame, truth: DataFrame, tolerance: int = 20) -> DataFrame:
    """Carrier pairs that no call was matched with: sample, id, family and the confidences (or filters) of calls nearby."""
    hit = judged.where("status = 'tp'").select("sample", "id").distinct()
    missed = pairs.select("sample", "id", "family").join(hit, ["sample", "id"], "left_anti")
    tier = F.when(F.col("passes"), F.col("confidence")).otherwise(F.lit("filtered"))
    beside = near(calls, truth, tolerance).join(calls.select("sample", "call", tier.alias("tier")), ["sample", "call"])
    told = beside.groupBy("sample", "id").agg(F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("call_tiers"))
    return missed.join(told, ["sample", "id"], "left").withColumn("call_tiers", F.coalesce("call_tiers", F.lit(".")))
