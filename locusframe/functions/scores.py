"""Genotype, quality and confidence as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be those of the published method for equal results.
ERROR_RATES = {"0/0": 0.02, "0/1": 0.3, "1/1": 0.98}
PRIORS = {"0/1": 0.77, "1/1": 0.23}
QUALITY_PRIOR = 0.501
QUALITY_WEIGHTS = {
    "both_junctions": (-0.193, 0.184),
    "tail": (0.560, -0.251),
    "tsd": (-0.302, 0.056),
    "identity": (0.276, -0.577),
    "distinct_starts": (0.156, -0.152),
    "mei_mates": (0.665, -0.561),
    "ratio": (0.156, -0.862),
}


def phred(p: Column, most: int = 99) -> Column:
    """-10 log10 p, rounded half away from zero, within 0 and ``most``; p of 0 or less gives ``most``."""
    value = F.round(-10 * F.log10(p))
    return F.when(p <= 0, F.lit(most)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(float(most)))).cast("int")


def round3(value: Column) -> Column:
    """Three decimals, by scaling to an integer."""
    return F.round(value * 1000) / 1000


def signal_ratio(support: Column, depth: Column) -> Column:
    """Support by depth (1 at least); null without a depth."""
    return support / F.greatest(depth, F.lit(1)).cast("double")


def log_likelihoods(alt: Column, ref: Column, junctions: Column) -> Column:
    """Array of log10 likelihoods of 0/0, 0/1 and 1/1, averaged over the junctions that were counted."""
    share = F.greatest(junctions, F.lit(1)).cast("double")
    return F.array(*[(alt * math.log10(p) + ref * math.log10(1 - p)) / share for p in ERROR_RATES.values()])


def genotype(alt: Column, ref: Column, junctions: Column, passes: Column, depth: Column | None = None) -> Column:
    """Struct (call, quality, likelihoods).

    The prior, used only for candidates that pass, picks the call and has no say in the
    quality. Of equal posteriors the later call wins. Without reference reads, 1/1 becomes 0/1
    where the alternative reads are few for the depth.
    """
    ll = log_likelihoods(alt, ref, junctions)
    no, het, hom = (F.get(ll, F.lit(i)) for i in range(3))
    with_prior = [F.when(passes, F.lit(float("-inf"))).otherwise(no), F.when(passes, het + math.log10(PRIORS["0/1"])).otherwise(het), F.when(passes, hom + math.log10(PRIORS["1/1"])).otherwise(hom)]
    first = F.when((with_prior[2] >= with_prior[1]) & (with_prior[2] >= with_prior[0]), F.lit("1/1")).when(with_prior[1] >= with_prior[0], F.lit("0/1")).otherwise(F.lit("0/0"))
    few = (ref == 0) & (alt.cast("double") < 0.2 * depth) if depth is not None else F.lit(False)
    call = F.when((first == "1/1") & few, F.lit("0/1")).otherwise(first)
    best = F.when(call == "0/0", no).when(call == "0/1", het).otherwise(hom)
    total = F.pow(F.lit(10.0), no - best) + F.pow(F.lit(10.0), het - best) + F.pow(F.lit(10.0), hom - best)
    return F.struct(call.alias("call"), phred(1 - 1 / total).alias("quality"), ll.alias("likelihoods"))


def quality_score(features: dict[str, Column]) -> Column:
    """Quality from the present and absent weights of the seven features (boolean; null counts as absent)."""
    total = F.lit(QUALITY_PRIOR)
    for name, (present, absent) in QUALITY_WEIGHTS.items():
        total = total + F.when(features[name], F.lit(present)).otherwise(F.lit(absent))
    return phred(1 / (1 + F.pow(F.lit(10.0), total)))


def most_quality() -> int:
    """The quality of a candidate for which each feature speaks as well as it can."""
    total = QUALITY_PRIOR + sum(max(pair) for pair in QUALITY_WEIGHTS.values())
    return int(-10 * math.log10(1 / (1 + 10**total)) + 0.5)


def confidence(passes: Column, tail: Column, by_mates: Column, tsd: Column) -> Column:
    """high, medium or low for candidates that pass, else null."""
    return F.when(~passes, F.lit(None)).when(~tail | by_mates, F.lit("low")).when(tsd, F.lit("high")).otherwise(F.lit("medium"))


def first_reason(reasons: list[tuple[Column, str]], otherwise: str = "kept") -> Column:
    """The name of the first condition that holds (null counts as not), as an exclusion cascade reports it."""
    out = None
    for condition, name in reasons:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def reason_list(reasons: list[tuple[Column, str]]) -> Column:
    """Array of the names of all conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in reasons]))
