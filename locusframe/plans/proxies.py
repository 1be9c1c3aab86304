"""Registered queries: each operator over the given tables, with the same result in DuckDB SQL.

The tables stand in for reads: users, customers and suppliers for contigs, times and dates
for positions, and texts hashed to letters for DNA.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import matching, metrics
from ..functions import alignment as al
from ..functions import scores as sc
from ..functions import seeds
from ..functions import sequences as sq
from ..operators import intervals as iv
from ..operators import positions as po
from ..operators import statistics as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL with its result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(column: str) -> Column:
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000).cast("long")


def _days(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals: contig user_id, position in seconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", _seconds("ts").alias("pos"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals: contig o_custkey, thirty days from the order's on."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _days("o_orderdate").alias("s"), (_days("o_orderdate") + 30).alias("e"))


_EVENTS = "events_p as (select event_id, user_id, event_type, value, epoch_us(ts) // 1000000 as pos from events)"
_CLUSTERS = f"""{_EVENTS}, marked as (
  select *, case when pos - lag(pos) over w > 21600 or lag(pos) over w is null then 1 else 0 end as opens from events_p window w as (partition by user_id order by pos, event_id)
), numbered as (
  select *, sum(opens) over (partition by user_id order by pos, event_id rows unbounded preceding) as no from marked
), clustered as (
  select *, min(pos) over (partition by user_id, no) as cluster_start from numbered
)"""
_SPANS = "spans as (select o_orderkey, o_custkey, date_diff('day', date '1970-01-01', o_orderdate::date) as s, date_diff('day', date '1970-01-01', o_orderdate::date) + 30 as e from orders)"
_MERGED = f"""{_SPANS}, reach as (
  select *, max(e) over (partition by o_custkey order by s, e rows between unbounded preceding and 1 preceding) as r from spans
), islands as (
  select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by o_custkey order by s, e rows unbounded preceding) as island from reach
), merged as (
  select o_custkey, min(s) as "start", max(e) as "end", count(*) as merged from islands group by o_custkey, island
)"""
CLUSTER_GAP = 21_600


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.gap_clusters(events(spark, sf_dir), ["user_id"], "pos", CLUSTER_GAP, ["event_id"])


@query(f"with {_CLUSTERS} select event_id, user_id, pos, cluster_start from clustered")
def gap_cluster(spark, sf_dir):
    """Sessions of each user's events with gaps of up to six hours."""
    return clusters(spark, sf_dir).select("event_id", "user_id", "pos", "cluster_start")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cluster, as candidates are profiled."""
    rows = clusters(spark, sf_dir).withColumn("hour", F.expr("pos div 3600"))
    keys = ["user_id", "cluster_start"]
    modes = st.smallest_mode(rows, keys, "hour").select(F.col("user_id").alias("m_user"), F.col("cluster_start").alias("m_start"), F.col("mode").alias("mode_hour"))
    joined = rows.join(modes, (F.col("user_id") == F.col("m_user")) & (F.col("cluster_start") == F.col("m_start")))
    kind = F.col("event_type")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("support"),
        F.count_distinct("event_type").alias("kinds"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.min("mode_hour").alias("mode_hour"),
        F.count_if(F.abs(F.col("hour") - F.col("mode_hour")) <= 2).alias("near_mode"),
    )


_PROFILE = f"""{_CLUSTERS}, hours as (
  select user_id, cluster_start, pos // 3600 as hour, count(*) as n from clustered group by all
), modes as (
  select user_id, cluster_start, hour as mode_hour from hours qualify row_number() over (partition by user_id, cluster_start order by n desc, hour) = 1
), profile as (
  select user_id, cluster_start, count(*) as support, count(distinct event_type) as kinds, count_if(event_type = 'click') as clicks, count_if(event_type = 'view') as views,
         count_if(event_type = 'error') as errors, count_if(event_type = 'purchase') as purchases, min(pos) as first, max(pos) as last, min(mode_hour) as mode_hour, count_if(abs(pos // 3600 - mode_hour) <= 2) as near_mode
  from clustered join modes using (user_id, cluster_start) group by user_id, cluster_start
)"""


@query(f"""with {_CLUSTERS}, sides as (
  select user_id, cluster_start, max(pos) filter (where event_type in ('click', 'view')) as up, min(pos) filter (where event_type not in ('click', 'view')) as down,
         count(*) filter (where event_type in ('click', 'view')) as n_up, count(*) filter (where event_type not in ('click', 'view')) as n_down
  from clustered group by user_id, cluster_start
)
select user_id, cluster_start,
  case when up <= down + 3600 then (least(up, down) + greatest(up, down)) // 2 when up is not null and n_up >= n_down then up else down end as breakpoint,
  case when up <= down + 3600 then least(up, down) - 3600 when up is not null and n_up >= n_down then up - 3600 else down - 7200 end as first,
  case when up <= down + 3600 then greatest(up, down) + 3600 when up is not null and n_up >= n_down then up + 7200 else down + 3600 end as last
from sides""")
def mate_placement(spark, sf_dir):
    """Where two sides of signals put a breakpoint."""
    return st.placement(clusters(spark, sf_dir), ["user_id", "cluster_start"], "pos", F.col("event_type").isin("click", "view"), 3600, 7200)


@query(f"with {_MERGED} select * from merged")
def interval_merge(spark, sf_dir):
    """Each customer's order periods, those that touch merged."""
    return iv.merge_intervals(order_spans(spark, sf_dir), ["o_custkey"], "s", "e", 512)


@query(f'with {_MERGED} select o_custkey, sum("end" - "start")::bigint as covered from merged group by o_custkey')
def covered_span(spark, sf_dir):
    """Days that each customer's order periods cover."""
    return iv.covered(order_spans(spark, sf_dir), ["o_custkey"], start="s", end="e", width=512)


@query(f"""with {_MERGED}, ships as (
  select l_orderkey, l_linenumber, l_partkey, o_custkey as cust, date_diff('day', date '1970-01-01', l_shipdate::date) as d from lineitem join orders on l_orderkey = o_orderkey
)
select l_orderkey, l_linenumber, l_partkey, cust, d from ships where exists (select 1 from merged where o_custkey = cust and d < "end" and "start" < d + 7)""")
def region_semi_join(spark, sf_dir):
    """Shipments of which the week from their day on meets an order period of their customer."""
    regions = interval_merge(spark, sf_dir).select("o_custkey", "start", "end")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("cust"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _days("l_shipdate").alias("d"))
    ships = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "cust", "d")
    return iv.within_any(ships, regions, [("cust", "o_custkey")], (F.col("d"), F.col("d") + 7), (F.col("start"), F.col("end")))


@query(f"""with {_SPANS}, points as (select c_custkey, 9000 + (c_custkey % 7) * 300 as b from customer)
select c_custkey, b, count(o_custkey) as depth from points left join spans on o_custkey = c_custkey and s < b + 1 and b - 1 < e group by c_custkey, b""")
def local_depth(spark, sf_dir):
    """Order periods over a boundary of each customer, 0 where there is none."""
    points = table(spark, sf_dir, "customer").select("c_custkey", F.expr("9000 + (c_custkey % 7) * 300").alias("b"))
    return iv.depth_at(points, order_spans(spark, sf_dir), [("c_custkey", "o_custkey")], "b", (F.col("s"), F.col("e")))


@query(f"""with {_EVENTS}, edges as (select user_id as u, pos as edge from events_p where event_type = 'purchase')
select event_id, user_id, pos, min(abs(pos - edge)) as distance from (select * from events_p where event_type = 'click') join edges on u = user_id and abs(pos - edge) <= 7200 group by event_id, user_id, pos""")
def nearest_edge(spark, sf_dir):
    """Distance of each click to the user's nearest purchase within two hours."""
    signals = events(spark, sf_dir)
    points = signals.where("event_type = 'click'").select("event_id", "user_id", "pos")
    edges = signals.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("pos").alias("edge"))
    return iv.nearest_edge(points, edges, [("user_id", "u")], "pos", "edge", 7200)


@query("""select l_returnflag, case when l_linestatus = 'O' and l_quantity < 5 then 'unmapped' when l_returnflag = 'R' then 'secondary' when l_discount >= 0.09 then 'duplicate' when l_tax < 0.02 then 'low_mapq' else 'kept' end as outcome, count(*) as n
from lineitem group by all""")
def exclusion_cascade(spark, sf_dir):
    """Rows by the first reason that excludes them."""
    reasons = [((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 5), "unmapped"), (F.col("l_returnflag") == "R", "secondary"), (F.col("l_discount") >= 0.09, "duplicate"), (F.col("l_tax") < 0.02, "low_mapq")]
    return st.outcome_counts(table(spark, sf_dir, "lineitem"), sc.first_reason(reasons), ["l_returnflag"])


@query("""with v as (select l_returnflag, floor(l_extendedprice)::bigint as price from lineitem),
m as (select l_returnflag, count(*) as n, quantile_disc(price, 0.5) as median from v group by 1),
d as (select v.l_returnflag, quantile_disc(abs(price - median), 0.5) as mad from v join m using (l_returnflag) group by 1)
select l_returnflag, n, median, mad, (median + greatest(1, ceil(6 * 1.4826::double * mad)))::bigint as threshold from m join d using (l_returnflag)""")
def robust_threshold(spark, sf_dir):
    """Lower median, deviation and threshold of prices for each return flag."""
    prices = table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor("l_extendedprice").cast("long").alias("price"))
    return st.outlier_threshold(prices, ["l_returnflag"], "price")


@query("""with r as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1 as rank, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, l_orderkey, l_linenumber, l_partkey from r where n <= 40 or rank = 0 or rank * 40 // n <> (rank - 1) * 40 // n""")
def even_sample_40(spark, sf_dir):
    """At most 40 rows of each supplier, spread evenly."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return po.even_sample(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 40)


@query("""with c as (select l_partkey, l_quantity::bigint as boundary, count(*) as votes from lineitem group by 1, 2 having count(*) >= 2)
select l_partkey, boundary, votes from c qualify row_number() over (partition by l_partkey order by votes desc, abs(boundary - 25), boundary) = 1""")
def best_boundary(spark, sf_dir):
    """Each part's most frequent quantity; ties to that nearest 25."""
    votes = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("boundary"), F.lit(25).alias("guess"))
    return po.best_boundary(votes, ["l_partkey"], "boundary", "guess")


@query("""select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders qualify rank <= 8""")
def topk_per_group(spark, sf_dir):
    """The eight largest orders of each customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return po.top_rows(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8)


_COUNTS = """counts as (
  select l_partkey, count_if(l_returnflag = 'A' and l_linestatus = 'F') as alt_left, count_if(l_returnflag = 'A' and l_linestatus = 'O') as alt_right, count_if(l_returnflag <> 'A' and l_quantity > 25) as ref, count(*) as depth from lineitem group by l_partkey
)"""


def _allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.col("l_returnflag") == "A"
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(alt & (F.col("l_linestatus") == "F")).alias("alt_left"), F.count_if(alt & (F.col("l_linestatus") == "O")).alias("alt_right"), F.count_if(~alt & (F.col("l_quantity") > 25)).alias("ref"), F.count("*").alias("depth"))


@query(f"""with {_COUNTS}, l as (
  select *, alt_left + alt_right as alt, greatest((alt_left > 0)::int + (alt_right > 0)::int, 1)::double as j from counts
), ll as (
  select *, (alt * log10(0.02::double) + ref * log10(0.98::double)) / j as l0, (alt * log10(0.3::double) + ref * log10(0.7::double)) / j as l1, (alt * log10(0.98::double) + ref * log10(0.02::double)) / j as l2, depth >= 25 as passes from l
), posterior as (
  select *, case when passes then '-infinity'::double else l0 end as p0, case when passes then l1 + log10(0.77::double) else l1 end as p1, case when passes then l2 + log10(0.23::double) else l2 end as p2 from ll
), called as (
  select *, case when p2 >= p1 and p2 >= p0 then '1/1' when p1 >= p0 then '0/1' else '0/0' end as gt from posterior
), final as (
  select *, case when gt = '1/1' and ref = 0 and alt < 0.2::double * depth then '0/1' else gt end as call from called
), best as (
  select *, case call when '0/0' then l0 when '0/1' then l1 else l2 end as b from final
), p as (
  select *, 1 - 1 / (10::double ** (l0 - b) + 10::double ** (l1 - b) + 10::double ** (l2 - b)) as err from best
)
select l_partkey, call, (case when err <= 0 then 99 else least(greatest(round(-10 * log10(err)), 0), 99) end)::int as quality, round(l1, 6) as het_likelihood from p""")
def genotype_call(spark, sf_dir):
    """Binomial genotypes of each part from its allele counts."""
    counts = _allele_counts(spark, sf_dir)
    junctions = F.when(F.col("alt_left") > 0, 1).otherwise(0) + F.when(F.col("alt_right") > 0, 1).otherwise(0)
    g = sc.genotype(F.col("alt_left") + F.col("alt_right"), F.col("ref"), junctions, F.col("depth") >= 25, F.col("depth"))
    return counts.withColumn("g", g).select("l_partkey", "g.call", "g.quality", F.round(F.get("g.likelihoods", F.lit(1)), 6).alias("het_likelihood"))


_FEATURES = "kinds >= 3, clicks >= 1, views >= 1, near_mode::double / support >= 0.98, kinds::double / support >= 0.7, (clicks + views)::double / support >= 0.6, support::double / 20 >= 0.2"


def _quality_features() -> dict[str, Column]:
    share = lambda a, b: F.col(a).cast("double") / F.col(b)
    return {
        "both_junctions": F.col("kinds") >= 3,
        "tail": F.col("clicks") >= 1,
        "tsd": F.col("views") >= 1,
        "identity": share("near_mode", "support") >= 0.98,
        "distinct_starts": share("kinds", "support") >= 0.7,
        "mei_mates": (F.col("clicks") + F.col("views")).cast("double") / F.col("support") >= 0.6,
        "ratio": sc.signal_ratio(F.col("support"), F.lit(20)) >= 0.2,
    }


_QUALITY = f"""{_PROFILE}, scored as (
  select *, 0.501::double + case when kinds >= 3 then -0.193::double else 0.184::double end + case when clicks >= 1 then 0.56::double else -0.251::double end + case when views >= 1 then -0.302::double else 0.056::double end
   + case when near_mode::double / support >= 0.98::double then 0.276::double else -0.577::double end + case when kinds::double / support >= 0.7::double then 0.156::double else -0.152::double end
   + case when (clicks + views)::double / support >= 0.6::double then 0.665::double else -0.561::double end + case when support::double / 20 >= 0.2::double then 0.156::double else -0.862::double end as s from profile
), rated as (select *, least(greatest(round(-10 * log10(1 / (1 + 10::double ** s))), 0), 99)::int as qual from scored)"""


@query(f"with {_QUALITY} select user_id, cluster_start, qual from rated")
def quality_score(spark, sf_dir):
    """Naive-Bayes quality of each cluster."""
    return profile(spark, sf_dir).select("user_id", "cluster_start", sc.quality_score(_quality_features()).alias("qual"))


_REASONS = """case when support < 2 then 'low_support' end, case when clicks = 0 and views = 0 then 'no_junction' end, case when errors * 2 > support then 'non_mei_mates' end, case when support::double / 20 < 0.1::double then 'low_ratio' end, case when qual < 5 then 'low_qual' end"""


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = profile(spark, sf_dir).withColumn("qual", sc.quality_score(_quality_features()))
    reasons = [
        (F.col("support") < 2, "low_support"),
        ((F.col("clicks") == 0) & (F.col("views") == 0), "no_junction"),
        (F.col("errors") * 2 > F.col("support"), "non_mei_mates"),
        (sc.signal_ratio(F.col("support"), F.lit(20)) < 0.1, "low_ratio"),
        (F.col("qual") < 5, "low_qual"),
    ]
    return rated.withColumn("filters", sc.reason_list(reasons))


@query(f"""with {_QUALITY}, f as (select *, len(list_filter([{_REASONS}], lambda x: x is not null)) = 0 as passes from rated)
select user_id, cluster_start, case when not passes then null when clicks = 0 or purchases > 1 then 'low' when views > 0 then 'high' else 'medium' end as confidence from f""")
def confidence_tier(spark, sf_dir):
    """Confidence of the clusters that pass."""
    tier = sc.confidence(F.size("filters") == 0, F.col("clicks") > 0, F.col("purchases") > 1, F.col("views") > 0)
    return _filtered(spark, sf_dir).select("user_id", "cluster_start", tier.alias("confidence"))


_LETTERS = ("0123456789abcdef", "ACGTACGTACGTACGT")
_DNA = "translate(concat(md5(concat(coalesce(text, ''), '0')), md5(concat(coalesce(text, ''), '1')), md5(concat(coalesce(text, ''), '2'))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def dna(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Texts as sequences of 96 bases, some with a run of A or T at an end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seq = F.translate(F.concat(*[F.md5(F.concat(text, F.lit(str(i)))) for i in range(3)]), *_LETTERS)
    tailed = F.when(F.col(key) % 3 == 0, F.concat(F.lit("A" * 11 + "C" + "A" * 4), seq)).when(F.col(key) % 3 == 1, F.concat(seq, F.lit("T" * 12))).otherwise(seq)
    return table(spark, sf_dir, name).select(key, tailed.alias("seq"))


def _dna_sql(name: str = "documents", key: str = "doc_id") -> str:
    return f"dna as (select {key}, case {key} % 3 when 0 then 'AAAAAAAAAAACAAAA' || d when 1 then d || 'TTTTTTTTTTTT' else d end as seq from (select {key}, {_DNA} as d from {name}))"


_TAIL_SQL = """(select coalesce(max(i), 0) from (select i, substr({s}, i, 1) as x, length(replace(substr({s}, 1, i), '{b}', '')) as others from (select unnest(range(1, length({s}) + 1)) as i)) where x = '{b}' and (i - others)::double >= 0.8::double * i)"""


@query(f"""with {_dna_sql()}, sides as (select doc_id, false as at_end, seq as s from dna union all select doc_id, true, reverse(seq) from dna),
l as (select doc_id, at_end, {_TAIL_SQL.format(s='s', b='A')} as a, {_TAIL_SQL.format(s='s', b='T')} as t from sides)
select doc_id, at_end, case when greatest(a, t) < 10 then null when t > a then 'T' else 'A' end as base, (case when greatest(a, t) >= 10 then greatest(a, t) end)::int as length from l""")
def poly_tail(spark, sf_dir):
    """A or T tails at both ends of each sequence."""
    seqs = dna(spark, sf_dir)
    ends = [seqs.select("doc_id", F.lit(at_end).alias("at_end"), sq.poly_tail(F.col("seq"), at_end).alias("t")) for at_end in (False, True)]
    return ends[0].unionAll(ends[1]).select("doc_id", "at_end", "t.base", "t.length")


@query(f"with {_dna_sql()} select doc_id, translate(reverse(seq), 'ACGT', 'TGCA') as rc, translate(reverse(seq), 'ACGT', 'TGCA') as rc_kept from dna")
def revcomp(spark, sf_dir):
    """The other strand of each sequence."""
    seq = F.col("seq")
    return dna(spark, sf_dir).select("doc_id", sq.reverse_complement(seq).alias("rc"), sq.reverse_complement(seq, False).alias("rc_kept"))


def _kmers_sql(k: int, key: str = "doc_id") -> str:
    return f"(select {key}, i - 1 as position, substr(seq, i, {k}) as kmer from (select {key}, seq, unnest(range(1, length(seq) - {k} + 2)) as i from dna))"


_MIXED = " and ".join(f"5 * (11 - length(replace(kmer, '{b}', ''))) < 44" for b in "ACGT")


@query(f"with {_dna_sql()} select doc_id, position::int as position, kmer from {_kmers_sql(11)} where {_MIXED}")
def kmers11(spark, sf_dir):
    """The 11-mers of each sequence that can seed an alignment."""
    return dna(spark, sf_dir).select("doc_id", F.inline(sq.informative_kmers(F.col("seq"), 11))).select("doc_id", F.col("position").cast("int").alias("position"), "kmer")


@query(f"with {_dna_sql()} select doc_id, least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) as kmer, count(*) as n from {_kmers_sql(20)} group by all")
def canonical20(spark, sf_dir):
    """Canonical 20-mers of each sequence and how often they occur."""
    seqs = dna(spark, sf_dir)
    each = F.flatten(F.transform(F.array("seq"), lambda s: sq.canonical_kmers(s, 20)))  # the sequence is worked out once
    return st.many_counts(seqs.select("doc_id", F.explode(each).alias("kmer")), ["doc_id", "kmer"], seqs.count() * (96 + 16 - 19))


@query(f"with {_dna_sql()} select doc_id, regexp_replace(seq, 'A{{10,}}|T{{10,}}', '', 'g') as bare from dna")
def without_runs(spark, sf_dir):
    """Sequences without long A or T runs."""
    return dna(spark, sf_dir).select("doc_id", sq.without_runs(F.col("seq")).alias("bare"))


@query(f"with {_dna_sql()} select doc_id, list_max(list_transform(regexp_extract_all(seq, 'A+|T+'), lambda x: length(x)))::int as longest, length(regexp_extract(seq, '^A*'))::int as head, length(regexp_extract(seq, 'T*$'))::int as tail from dna")
def longest_run(spark, sf_dir):
    """Longest A or T run of each sequence, and pure runs at its ends."""
    seq = F.col("seq")
    return dna(spark, sf_dir).select("doc_id", sq.longest_run(seq).alias("longest"), sq.pure_run(seq, "A", False).alias("head"), sq.pure_run(seq, "T", True).alias("tail"))


_SEEDS = f"""with q as (select doc_id, {_DNA} as seq from documents), b as (select item_id, {_DNA} as seq from benchmark),
qk as (select doc_id, i - 1 as qpos, substr(seq, i, 11) as kmer from (select *, unnest(range(1, length(seq) - 9)) as i from q)),
bk as (select item_id, i - 1 as bpos, substr(seq, i, 11) as kmer from (select *, unnest(range(1, length(seq) - 9)) as i from b)),
mixed as (select item_id, bpos, kmer from bk where {' and '.join(f"5 * (11 - length(replace(kmer, '{b}', ''))) < 44" for b in 'ACGT')}),
seeds as (select doc_id, item_id, (bpos - qpos)::bigint as diagonal from qk join mixed using (kmer))"""


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents (id, seq) and benchmark items (ref, seq) as sequences."""
    out = []
    for name, key, alias in (("documents", "doc_id", "id"), ("benchmark", "item_id", "ref")):
        text = F.coalesce(F.col("text"), F.lit(""))
        out.append(table(spark, sf_dir, name).select(F.col(key).alias(alias), F.translate(F.concat(*[F.md5(F.concat(text, F.lit(str(i)))) for i in range(3)]), *_LETTERS).alias("seq")))
    return out


@query(f"{_SEEDS} select doc_id, item_id, count(*) as seeds from seeds group by all")
def kmer_seed_join(spark, sf_dir):
    """Number of seeds that each document and item share."""
    found = seeds.seeds(*_sides(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("ref").alias("item_id"))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("seeds"))


@query(f"""{_SEEDS}, spans as (
  select doc_id, item_id, diagonal, count(*) over w as seeds, min(diagonal) over w as first from seeds window w as (partition by doc_id, item_id order by diagonal range between 20 preceding and current row)
)
select distinct doc_id, item_id, seeds, first, diagonal as last from spans qualify row_number() over (partition by doc_id, item_id order by seeds desc, diagonal) = 1""")
def seed_band(spark, sf_dir):
    """The densest band of diagonals of each document and item."""
    return seeds.bands(*_sides(spark, sf_dir)).withColumnsRenamed({"id": "doc_id", "ref": "item_id"})


@query()
def local_alignment(spark, sf_dir):
    """Each document's sequence aligned with that of the item whose band of seeds is densest."""
    docs, items = _sides(spark, sf_dir)
    bands = seeds.bands(docs, items).withColumnsRenamed({"id": "doc_id", "ref": "item_id"})
    best = po.top_rows(bands, ["doc_id"], [F.desc("seeds"), F.asc("item_id")], 1)
    sides = [docs.withColumnsRenamed({"id": "doc_id", "seq": "doc_id_seq"}), items.withColumnsRenamed({"ref": "item_id", "seq": "item_id_seq"})]
    pairs = best.select("doc_id", "item_id", "seeds").join(sides[0], "doc_id").join(sides[1], "item_id")
    return pairs.withColumn("a", al.local_alignment(F.col("doc_id_seq"), F.col("item_id_seq"))).select("doc_id", "item_id", "seeds", "a.*")


@query("""with h as (select p_brand, l_orderkey, p_type, max(floor(l_extendedprice)::bigint) as s from lineitem join part on l_partkey = p_partkey group by all),
t as (select p_brand, p_type, sum(s)::bigint as total, count(*) as voters from h group by all)
select p_brand, p_type, total, voters from t qualify row_number() over (partition by p_brand order by total desc, p_type) = 1""")
def family_vote(spark, sf_dir):
    """The type with the greatest sum of its orders' best prices, for each brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_type").alias("rank"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.floor("l_extendedprice").cast("long").alias("price"))
    hits = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return st.vote(hits, ["p_brand"], "l_orderkey", "p_type", "rank", "price")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    junk = F.length(text) - F.length(F.translate(text, "#*$%&!|", ""))
    return docs.select("doc_id", "lang", (junk.cast("long") * 100).alias("junk"), F.length(text).cast("long").alias("chars")).withColumn("score", F.expr("junk div greatest(chars, 1)")).join(table(spark, sf_dir, "labels"), "doc_id")


_SCORED = "scored as (select d.doc_id, lang, (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&!|', ''))) * 100 as junk, length(coalesce(text, '')) as chars, junk // greatest(chars, 1) as score, quality, toxic from documents d join labels l on d.doc_id = l.doc_id)"


@query(f"""with {_SCORED}, c as (select lang, count_if(score >= 2 and quality = 0) as tp, count_if(score >= 2 and quality <> 0) as fp, count_if(score < 2 and quality = 0) as fn from scored group by lang)
select lang, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall from c""")
def precision_recall(spark, sf_dir):
    """How well a junk score finds documents of low quality, for each language."""
    got = metrics.rates(_scored(spark, sf_dir), F.col("score") >= 2, F.col("quality") == 0, ["lang"])
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""with {_SCORED}, p as (select score as s1 from scored where quality = 0), n as (select score as s0 from scored where quality = 1)
select round(sum(case when s1 > s0 then 1.0::double when s1 = s0 then 0.5::double else 0 end) / nullif(count(*), 0), 6) as auc from p, n""")
def auc(spark, sf_dir):
    """Share of pairs that the junk score puts in order."""
    return metrics.auc(_scored(spark, sf_dir).withColumn("bad", 1 - F.col("quality")), "score", "bad").select(F.round("auc", 6).alias("auc"))


@query(f"""with {_SCORED}, f as (select quality, (score >= 2)::int as junk_high, (chars >= 1000)::int as long, (lang = 'en')::int as english from scored),
w as (select quality, count(*) as n, sum(junk_high) as junk_high, sum(long) as long, sum(english) as english from f group by quality),
t as (unpivot w on junk_high, long, english into name feature value present),
b as (select feature, max(present) filter (where quality = 1) as p1, max(n) filter (where quality = 1) as n1, max(present) filter (where quality = 0) as p0, max(n) filter (where quality = 0) as n0 from t group by feature)
select feature, round(log10(((p1 + 1)::double / (n1 + 2)) / ((p0 + 1)::double / (n0 + 2))), 6) as present, round(log10((1 - (p1 + 1)::double / (n1 + 2)) / (1 - (p0 + 1)::double / (n0 + 2))), 6) as absent from b""")
def nb_fit(spark, sf_dir):
    """Smoothed log ratios of three features between good and bad documents."""
    rows = _scored(spark, sf_dir).select("quality", (F.col("score") >= 2).cast("int").alias("junk_high"), (F.col("chars") >= 1000).cast("int").alias("long"), (F.col("lang") == "en").cast("int").alias("english"))
    fit = metrics.naive_bayes(rows, ["junk_high", "long", "english"], "quality")
    return fit.select("feature", *[F.round(c, 6).alias(c) for c in ("present", "absent")])


@query(f"""with {_EVENTS}, m as (select user_id, pos, case when pos - lag(pos) over (partition by user_id order by pos) <= 3600 then 0 else 1 end as o from events_p where event_type = 'error'),
n as (select *, sum(o) over (partition by user_id order by pos range unbounded preceding) as no from m)
select user_id, min(pos) as first, max(pos) as last, count(*) as points from n group by user_id, no""")
def loci(spark, sf_dir):
    """Runs of errors of each user with gaps of up to an hour."""
    return iv.loci(events(spark, sf_dir).where("event_type = 'error'").select("user_id", "pos"), ["user_id"], "pos", 3600)


_LIFT = f"""{_SPANS}, blocks as (select o_custkey as source, s, e, o_orderkey % 11 as score, o_orderkey as chain, o_custkey + 100000 as q_contig, 4000 as q_size, case when o_orderkey % 2 = 0 then '-' else '+' end as strand, o_orderkey % 97 as q_start from spans),
points as (select distinct o_custkey, s + 9 as p from spans)"""


@query(f"""with {_LIFT}, hits as (select o_custkey, p, q_contig, case when strand = '-' then q_size - 1 - (q_start + p - s) else q_start + p - s end as to_, row_number() over (partition by o_custkey, p order by score desc, chain) as r from points join blocks on source = o_custkey and s <= p and p < e)
select points.o_custkey, points.p, q_contig as lifted_contig, to_::bigint as lifted from points left join hits on hits.o_custkey = points.o_custkey and hits.p = points.p and r = 1""")
def liftover(spark, sf_dir):
    """Positions mapped through the best block over them."""
    spans = order_spans(spark, sf_dir)
    blocks = spans.select(F.col("o_custkey").alias("source"), "s", "e", (F.col("o_orderkey") % 11).alias("score"), F.col("o_orderkey").alias("chain"), (F.col("o_custkey") + 100000).alias("q_contig"), F.lit(4000).alias("q_size"), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("+").alias("strand"), (F.col("o_orderkey") % 97).alias("q_start"))
    points = spans.select("o_custkey", (F.col("s") + 9).alias("p")).distinct()
    return iv.lift(points, blocks, "o_custkey", "p")


#: Rounds of pairs that come first for both sides, with what they leave.
GREEDY = """select {keys}, l, r, d, best as taken from (
  select *, bool_or(best) over (partition by {keys}, l) or bool_or(best) over (partition by {keys}, r) as blocked from (
    select *, row_number() over (partition by {keys}, l order by d, l, r) = 1 and row_number() over (partition by {keys}, r order by d, l, r) = 1 as best from rest where not taken)
) where best or not blocked"""


@query(f"""with recursive {_EVENTS}, rest as (
  select a.user_id, a.event_id as l, b.event_id as r, abs(a.pos - b.pos) as d, false as taken
  from events_p a join events_p b on a.user_id = b.user_id and abs(a.pos - b.pos) <= 7200 where a.event_type = 'click' and b.event_type = 'purchase'
  union all {GREEDY.format(keys="user_id")})
select user_id, l as click, r as purchase, d as distance from rest where taken""")
def one_to_one_match(spark, sf_dir):
    """Clicks and purchases of each user within two hours, matched one to one by distance."""
    signals = events(spark, sf_dir).where("event_type in ('click', 'purchase')")
    return matching.match_by_position(signals.withColumn("is_click", F.col("event_type") == "click"), ["user_id"], "pos", "is_click", "event_id", 7200, "click", "purchase")


@query()
def clopper_pearson(spark, sf_dir):
    """Exact lower bound of each supplier's share of returned lines."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("lines"))
    return metrics.with_lower_bound(counts, "returned", "lines")


@query()
def two_way_bootstrap(spark, sf_dir):
    """Interval of the share of returned lines, with suppliers and parts' brands drawn anew."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey"), (F.col("l_returnflag") == "R").cast("int").alias("hit"), F.lit(1).alias("one"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return metrics.bootstrap(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "p_brand", "hit", "one", 100)
