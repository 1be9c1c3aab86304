"""Registered queries of the evaluation: events stand for calls and truths, documents for labelled calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import calls as ec
from ..evaluation import metrics, refit
from .proxies import _EVENTS, _SCORED, GREEDY, _scored, events, query, table


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls of four samples, with a second point up to a minute and a half later."""
    i = F.col("event_id")
    rows = events(spark, sf_dir).where("event_type = 'click'")
    family = F.when(i % 5 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ("Alu", "L1", "SVA"))), (i % 3 + 1).cast("int")))
    return rows.select(F.concat(F.lit("s"), (i % 4).cast("string")).alias("sample"), i.alias("call"), F.col("user_id").alias("contig"), F.array("pos", F.col("pos") + i % 90).alias("points"), family.alias("family"), (i % 7 != 0).alias("passes"), (i % 40).cast("int").alias("qual"), F.element_at(F.array(*map(F.lit, ec.TIERS)), (i % 3 + 1).cast("int")).alias("confidence"), F.when(i % 2 == 0, F.lit("0/1")).otherwise(F.lit("1/1")).alias("genotype"), (i % 9 == 0).alias("imprecise"))


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as truths, and a genotype of each sample for each."""
    i = F.col("event_id")
    rows = events(spark, sf_dir).where("event_type = 'purchase'")
    truth = rows.select(i.alias("id"), F.col("user_id").alias("contig"), F.col("pos"), F.element_at(F.array(*map(F.lit, ("Alu", "L1", "SVA", "other"))), (i % 4 + 1).cast("int")).alias("family"))
    tall = truth.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s"))
    which = ((F.col("id") + F.col("s") * 3) % 5 + 1).cast("int")
    return truth, tall.select("id", F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), F.element_at(F.array(*map(F.lit, ("0|1", "0|0", "1|1", ".|0", "1|0"))), which).alias("genotype"))


@query(f"""with {_EVENTS}, calls as (select 's' || (event_id % 4) as sample, event_id as call, user_id, unnest([pos, pos + event_id % 90]) as p_ from events_p where event_type = 'click'),
truth as (select event_id as id, user_id, pos from events_p where event_type = 'purchase')
select sample, call, id, min(abs(p_ - pos)) as distance from calls join truth using (user_id) where abs(p_ - pos) <= 7200 group by all""")
def truth_near(spark, sf_dir):
    """Truths within two hours of some point of a call."""
    return ec.near(_calls(spark, sf_dir), _truth(spark, sf_dir)[0], 7200)


@query(f"""with {_EVENTS}, targets as (select user_id as t, pos as s, pos + event_id % 5000 as e from events_p where event_type = 'purchase'), points as (select distinct user_id, pos from events_p where event_type = 'error'),
away as (select user_id, pos, min(greatest(0, s - pos, pos - e)) as d from points join targets on t = user_id group by all)
select user_id, pos, case when d <= 5000 then d end as distance, coalesce(d = 0, false) as inside from points left join away using (user_id, pos)""")
def target_distance(spark, sf_dir):
    """Distance of each error to the user's nearest target, and whether one holds it."""
    rows = events(spark, sf_dir)
    targets = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("contig"), F.col("pos").alias("start"), (F.col("pos") + F.col("event_id") % 5000).alias("end"))
    points = rows.where("event_type = 'error'").select("user_id", "pos").distinct()
    inside = ec.in_targets(points, targets, "user_id", "pos").withColumn("inside", F.lit(True))
    return ec.target_distance(points, targets, "user_id", "pos", 5000).join(inside, ["user_id", "pos"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


_CASES = f"""{_EVENTS}, calls as (
  select 's' || (event_id % 4) as sample, event_id as call, user_id, [pos, pos + event_id % 90] as points, case when event_id % 5 > 0 then ['Alu', 'L1', 'SVA'][event_id % 3 + 1] end as family, event_id % 7 <> 0 as passes, event_id % 9 = 0 as imprecise
  from events_p where event_type = 'click'
), truth as (
  select event_id as id, user_id, pos, ['Alu', 'L1', 'SVA', 'other'][event_id % 4 + 1] as family from events_p where event_type = 'purchase'
), genotypes as (
  select id, 's' || s as sample, ['0|1', '0|0', '1|1', '.|0', '1|0'][(id + s * 3) % 5 + 1] as genotype from truth, range(4) r(s)
), tall as (select * from calls, (values {{tolerances}}) t(tolerance) where {{which}}), near as (
  select tolerance, sample, call, id, min(abs(p - pos)) as d from (select *, unnest(points) as p from tall) c join truth t on c.user_id = t.user_id where abs(p - pos) <= tolerance group by all
), told as (
  select n.*, genotype, contains(genotype, '1') as own, contains(genotype, '.') as unknown, (select bool_or(contains(g.genotype, '1')) from genotypes g where g.id = n.id) as other
  from near n join genotypes g using (id, sample)
), rest as (
  select tolerance, sample, call as l, id as r, d, false as taken from told where own
  union all {GREEDY.format(keys="tolerance, sample")}
), flags as (
  select tolerance, sample, call, bool_or(own) as own, bool_or(unknown) as unknown, bool_or(other) as other from told group by all
), judged as (
  select c.*, m.r as id, g.genotype as genotype_of_truth,
         case when m.r is not null then case when c.family is null or t.family = 'other' or c.family = t.family then 'tp' else 'wrong_family' end
              when f.own then 'duplicate' when f.unknown then 'unknown' when f.other then 'other_sample' else 'fp' end as status
  from tall c left join flags f using (tolerance, sample, call) left join (select * from rest where taken) m on c.tolerance = m.tolerance and c.sample = m.sample and c.call = m.l
  left join truth t on m.r = t.id left join genotypes g on m.r = g.id and g.sample = c.sample
)"""


@query(f"with recursive {_CASES.format(tolerances='(7200)', which='true')} select sample, call, status, id, genotype_of_truth from judged")
def call_statuses(spark, sf_dir):
    """Calls and the truths that they are matched with one to one."""
    return ec.statuses(_calls(spark, sf_dir), *_truth(spark, sf_dir), 7200).select("sample", "call", "status", "id", "genotype_of_truth")


@query(f"""with recursive {_CASES.format(tolerances="(600), (3600), (7200)", which="passes")}, tables as (
  select *, unnest(['all', case when imprecise then 'imprecise' else 'precise' end]) as kind from judged
), counts as (
  select tolerance, kind, count(*) as calls, count_if(status = 'tp')::bigint as tp, count_if(status in ('fp', 'wrong_family', 'duplicate'))::bigint as false_, count_if(status = 'wrong_family')::bigint as wrong_family, count_if(status = 'duplicate')::bigint as duplicate, count(distinct case when status = 'tp' then sample || ' ' || id end) as found
  from tables group by all
)
select tolerance, kind, calls, tp, false_ as "false", wrong_family, duplicate, tp / nullif((tp + false_)::double, 0) as precision,
       case when kind = 'all' then found / nullif((select count(*) from genotypes where contains(genotype, '1') and sample in (select sample from calls))::double, 0) end as recall
from counts""")
def tolerance_table(spark, sf_dir):
    """Precision and recall of the calls that pass, at several tolerances."""
    return ec.by_tolerance(_calls(spark, sf_dir), *_truth(spark, sf_dir), [600, 3600, 7200])


_STATUSES = ("tp", "fp", "wrong_family", "duplicate", "other_sample", "unknown")


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls with a status made of their number, and carrier pairs."""
    i = F.col("event_id")
    rows = events(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (i % 6 + 1).cast("int"))
    site = F.expr("event_id div 24")
    judged = rows.select(F.concat(F.lit("s"), (i % 4).cast("string")).alias("sample"), i.alias("call"), (F.col("user_id") % 50).alias("contig"), F.array(F.col("pos") % 500_000).alias("points"), F.element_at(F.array(*map(F.lit, ec.TIERS)), (i % 3 + 1).cast("int")).alias("confidence"), status.alias("status"), F.when(status == "tp", site).alias("id"))
    pairs = rows.where("event_id % 3 = 0").select(F.concat(F.lit("s"), (i % 4).cast("string")).alias("sample"), site.alias("id"), (site % 50).alias("contig"), (site * 37 % 500_000).alias("pos"), F.when(site % 4 == 0, F.lit("Alu")).otherwise(F.lit("L1")).alias("family"), (site % 70).alias("carriers")).distinct()
    return judged, pairs


_JUDGED = f"""{_EVENTS}, judged as (
  select 's' || (event_id % 4) as sample, event_id as call, user_id % 50 as contig, pos % 500000 as p_, ['high', 'medium', 'low'][event_id % 3 + 1] as confidence, ['tp', 'fp', 'wrong_family', 'duplicate', 'other_sample', 'unknown'][event_id % 6 + 1] as status, case when event_id % 6 = 0 then event_id // 24 end as id from events_p
), pairs as (
  select distinct 's' || (event_id % 4) as sample, event_id // 24 as id, event_id // 24 % 50 as contig, event_id // 24 * 37 % 500000 as pos, case when event_id // 24 % 4 = 0 then 'Alu' else 'L1' end as family, event_id // 24 % 70 as carriers from events_p where event_id % 3 = 0
), hit as (select distinct sample, id from judged where status = 'tp')"""
_FALSE = "status in ('fp', 'wrong_family', 'duplicate')"
_LOCI = f"""points as (select contig, pos as position from pairs union select contig, p_ from judged where {_FALSE}),
opened as (select *, case when position - lag(position) over (partition by contig order by position) <= 100 then 0 else 1 end as o from points),
runs as (select *, sum(o) over (partition by contig order by position) as no from opened), loci as (select contig, position, min(position) over (partition by contig, no) as locus from runs)"""


@query(f"""with {_JUDGED}, c as (select sample, count(*) as calls, {", ".join(f"count_if(status = '{s}')::bigint as {s}" for s in _STATUSES)}, count_if({_FALSE})::bigint as false_, count(distinct case when status = 'tp' then id end) as found,
  {", ".join(f"count_if(confidence = '{t}' and status = 'tp')::bigint as tp_{t}, count_if(confidence = '{t}')::bigint as calls_{t}" for t in ec.TIERS)} from judged group by sample), t as (select sample, count(*) as truth from pairs group by sample)
select sample, truth, calls, {", ".join(_STATUSES)}, false_ as "false", found, {", ".join(f"tp_{t}, calls_{t}" for t in ec.TIERS)}, round(tp::double / nullif(tp + false_, 0), 6) as precision, round(found::double / nullif(truth, 0), 6) as recall from t join c using (sample)""")
def call_summary(spark, sf_dir):
    """Calls of each sample by status and confidence, precision and recall."""
    got = ec.summary(*_judged(spark, sf_dir), ["sample"])
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""with {_JUDGED}, {_LOCI}, cells as (
  select p.sample, contig, pos as position, (h.id is not null)::int as tp, 0 as false_, (h.id is null)::int as fn from pairs p left join hit h on p.sample = h.sample and p.id = h.id union all select sample, contig, p_, 0, 1, 0 from judged where {_FALSE}
) select sample, contig, locus, sum(tp)::bigint as tp, sum(false_)::bigint as "false", sum(fn)::bigint as fn from cells join loci using (contig, position) group by all""")
def locus_outcomes(spark, sf_dir):
    """True, false and missed of each sample and locus."""
    judged, pairs = _judged(spark, sf_dir)
    return ec.outcomes(judged, pairs, ec.loci(judged, pairs))


@query(f"""with {_JUDGED}, {_LOCI}, s as (select id, count(*) as n, count(h.id) as hits from pairs p left join hit h using (sample, id) group by id), f as (select loci.contig, locus from judged join loci on judged.contig = loci.contig and p_ = position where {_FALSE})
select (select sum(n) from s)::bigint as pairs, (select count(*) from s) as sites, (select count(*) from s where hits > 0) as found_in_some, (select count(*) from s where hits = n) as found_in_every, (select count(*) from f) as false_calls, (select count(*) from (select distinct contig, locus from f)) as false_loci""")
def site_units(spark, sf_dir):
    """Carrier pairs and sites, those found, and the loci of false calls."""
    judged, pairs = _judged(spark, sf_dir)
    return ec.units(judged, pairs, ec.loci(judged, pairs))


@query(f"""with {_JUDGED}, tall as (select h.id is not null as hit, unnest([{{'stratum': 'family', 'name': family}}, {{'stratum': 'carriers', 'name': case when carriers < 4 then '< 4' when carriers < 17 then '4-16' when carriers < 33 then '17-32' else '>= 33' end}}], recursive := true) from pairs p left join hit h on p.sample = h.sample and p.id = h.id)
select stratum, name, count_if(hit)::bigint as found, count(*) as total, round(count_if(hit)::double / count(*), 6) as recall from tall group by stratum, name""")
def stratum_recall(spark, sf_dir):
    """Recall of carrier pairs by family and by number of carriers."""
    strata = {"family": F.col("family"), "carriers": ec.labels(F.col("carriers"), [4, 17, 33])}
    got = ec.by_stratum(*_judged(spark, sf_dir), strata)
    return got.select("stratum", "name", "found", "total", F.round("recall", 6).alias("recall"))


_FLAGS = ["junk_high", "long", "english"]


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", (F.col("doc_id") % 5).alias("sample"), F.col("quality").alias("label"), (F.col("score") >= 2).cast("int").alias("junk_high"), (F.col("chars") >= 1000).cast("int").alias("long"), (F.col("lang") == "en").cast("int").alias("english"))


_LOO = f"""{_SCORED}, f as (select doc_id, doc_id % 5 as sample, quality as label, (score >= 2)::int as junk_high, (chars >= 1000)::int as long, (lang = 'en')::int as english from scored),
g as (select distinct sample from f), c as (select g.sample, count_if(label = 1) as n1, count_if(label = 0) as n0, {", ".join(f"sum({x}) filter (where label = 1) as {x}_1, sum({x}) filter (where label = 0) as {x}_0" for x in _FLAGS)} from g join f on f.sample <> g.sample group by g.sample),
scores as (select doc_id, label, log10((n1 + 1)::double / (n0 + 1)) + {" + ".join(f"case when {x} = 1 then log10((({x}_1 + 1)::double / (n1 + 2)) / (({x}_0 + 1)::double / (n0 + 2))) else log10((1 - ({x}_1 + 1)::double / (n1 + 2)) / (1 - ({x}_0 + 1)::double / (n0 + 2))) end" for x in _FLAGS)} as s from f join c using (sample))"""


@query(f"with {_LOO} select doc_id, label, round(s, 6) as score from scores")
def loo_scores(spark, sf_dir):
    """Scores of labelled documents by naive-Bayes models that their group took no part in."""
    rows = _flagged(spark, sf_dir)
    got = refit.scored(rows, refit.models(rows, _FLAGS, "label", "sample"), _FLAGS, "sample")
    return got.select("doc_id", "label", F.round("score", 6).alias("score"))


@query(f"""with {_LOO}, q as (select label, least(round_even(-10 * log10(greatest(1 / (1 + 10::double ** s), 1e-12::double)), 0), 60) as qual from scores)
select threshold::int as threshold, count_if(label = 1)::bigint as tp, count_if(label = 0)::bigint as fp, round(count_if(label = 1)::double / greatest(count(*), 1), 6) as precision from q join (select unnest([0, 2, 5, 8, 10]) as threshold) on qual >= threshold group by threshold""")
def qual_kept(spark, sf_dir):
    """Documents of both labels of which the score's quality reaches each threshold."""
    rows = _flagged(spark, sf_dir)
    got = refit.scored(rows, refit.models(rows, _FLAGS, "label", "sample"), _FLAGS, "sample")
    return refit.kept(got, "label", [0, 2, 5, 8, 10]).withColumn("precision", F.round("precision", 6))


@query("""with r as (select c_custkey, c_nationkey * 40 + c_custkey % 40 as family_id, case c_custkey % 97 when 0 then 'other' when 1 then 'related' else case when c_custkey % 40 % 9 < 5 or c_custkey % 53 = 0 then 'tuning' else 'test' end end as set_ from customer),
f as (select family_id, count_if(set_ = 'tuning') as a, count_if(set_ = 'test') as b, count_if(set_ = 'related') as c from r group by family_id)
select 'unknown set' as problem, c_custkey as "of" from r where set_ = 'other' union all select 'in tuning and test', family_id from f where a > 0 and b > 0 union all select 'related without tuning', family_id from f where c > 0 and a = 0""")
def split_leaks(spark, sf_dir):
    """Families of customers that a split divides, and unknown sets."""
    c = F.col("c_custkey")
    chosen = F.when(c % 97 == 0, F.lit("other")).when(c % 97 == 1, F.lit("related")).when((c % 40 % 9 < 5) | (c % 53 == 0), F.lit("tuning")).otherwise(F.lit("test"))
    rows = table(spark, sf_dir, "customer").select(c.alias("sample"), (F.col("c_nationkey") * 40 + c % 40).alias("family_id"), chosen.alias("set"))
    return refit.split_leaks(rows)


@query()
def lower_bounds(spark, sf_dir):
    """Exact lower bound of each stratum's recall."""
    judged, pairs = _judged(spark, sf_dir)
    return metrics.with_lower_bound(ec.by_stratum(judged, pairs, {"family": F.col("family"), "contig": F.col("contig").cast("string")}).drop("lower_bound"), "found", "total")
