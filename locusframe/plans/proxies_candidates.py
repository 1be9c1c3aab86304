"""Registered queries that run the steps of the scan over signals made of the given tables.

Events stand for signals: their user is the contig, the hour the position, the kind of event
the kind of signal. Orders stand for reads: the customer is the contig, the days the position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import assembly as asm
from ..functions import scores as sc
from ..functions import sequences as sq
from ..operators import statistics as st
from ..options import Calling
from ..sinks import report
from . import candidates as ca
from . import junctions, mates, typing
from .proxies import _EVENTS, _SPANS, dna, events, order_spans, query, table

_CALLING = Calling(window=6, min_support=2, profile="exome", min_qual=5, min_signal_ratio=0.15)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals with the columns of extract.signals that candidates are made of."""
    kind = {"click": "soft_clip", "view": "soft_clip", "error": "mate_unmapped", "purchase": "mate_elsewhere"}
    named = F.lit("large_insert")
    for event, signal in kind.items():
        named = F.when(F.col("event_type") == event, F.lit(signal)).otherwise(named)
    i = F.col("event_id")
    clip = named == "soft_clip"
    tail = F.struct(F.when(i % 4 < 2, F.lit("A")).otherwise(F.lit("T")).alias("base"), (10 + i % 9).cast("int").alias("length"))
    hour = F.expr("pos div 3600")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("contig"), hour.alias("position"), (i % 2).cast("int").alias("side"), F.concat(F.lit("r"), (i % 997).cast("string")).alias("read"), (i % 5 < 3).alias("first_segment"), named.alias("kind"), (i % 3 == 0).alias("reverse"),
        (hour - i % 40).alias("start"), (hour + i % 31).alias("end"), F.when(clip, i % 4 == 0).alias("short"), F.when(clip, i % 5 == 0).alias("supplementary"), F.when(clip & (i % 6 < 2), tail).alias("tail"), i.alias("event_id"),
    )


_SIGNALS = f"""{_EVENTS}, signals as (
  select user_id as contig, pos // 3600 as position, event_id % 2 as side, 'r' || (event_id % 997) as read, event_id % 5 < 3 as first_segment,
         case event_type when 'click' then 'soft_clip' when 'view' then 'soft_clip' when 'error' then 'mate_unmapped' when 'purchase' then 'mate_elsewhere' else 'large_insert' end as kind, event_id % 3 = 0 as reverse,
         pos // 3600 - event_id % 40 as "start", pos // 3600 + event_id % 31 as "end", event_type in ('click', 'view') as clip, event_type in ('click', 'view') and event_id % 4 = 0 as short,
         case when event_type in ('click', 'view') and event_id % 6 < 2 then case when event_id % 4 < 2 then 'A' else 'T' end end as base, 10 + event_id % 9 as tail_length, event_id from events_p
), opened as (
  select *, case when position - lag(position) over (partition by contig order by position) <= 6 then 0 else 1 end as opens from signals
), numbered as (
  select *, sum(opens) over (partition by contig order by position range unbounded preceding) as no from opened
), rows_ as (
  select *, min(position) over (partition by contig, no) as cluster_start from numbered
)"""

_CANDIDATES = f"""{_SIGNALS}, counted as (
  select contig, cluster_start, position, count(*) filter (where clip and side = 1) as l, count(*) filter (where clip and side = 0) as r, count(*) filter (where clip) as c from rows_ group by all
), modes as (
  select contig, cluster_start, arg_min(position, (-l, position)) filter (where l > 0) as left_junction, arg_min(position, (-r, position)) filter (where r > 0) as right_junction, arg_min(position, (-c, position)) filter (where c > 0) as clip_mode from counted group by all
), mates_ as (
  select contig, cluster_start, max(position) filter (where side = 1) as up, min(position) filter (where side = 0) as down, count(*) filter (where side = 1) as n_up, count(*) filter (where side = 0) as n_down from rows_ where not clip group by all
), placed as (
  select contig, cluster_start,
    case when up <= down + 20 then (least(up, down) + greatest(up, down)) // 2 when up is not null and n_up >= n_down then up else down end as mate_point,
    case when up <= down + 20 then least(up, down) - 20 when up is not null and n_up >= n_down then up - 20 else down - 300 end as mate_first,
    case when up <= down + 20 then greatest(up, down) + 20 when up is not null and n_up >= n_down then up + 300 else down + 20 end as mate_last from mates_
), sums as (
  select contig, cluster_start, count(distinct read) as support, count(distinct (reverse, case when reverse then "end" else "start" end)) as distinct_starts, min(position) as "start", max(position) as "end", count(*) filter (where clip) as clips,
    count(*) filter (where clip and side = 0) as left_side_clips, count(*) filter (where clip and side = 1) as right_side_clips, count(*) filter (where kind = 'mate_unmapped') as unmapped_mates, count(*) filter (where not clip and kind <> 'mate_unmapped') as discordant_mates,
    count(*) filter (where base is not null) as tail_clips, count(*) filter (where base = 'A') as polya_clips, count(*) filter (where base = 'T') as polyt_clips, count(distinct side) = 2 as both_sides,
    count(*) filter (where clip and side = 1 and abs(position - left_junction) <= 2) as left_clips, count(*) filter (where clip and side = 0 and abs(position - right_junction) <= 2) as right_clips,
    count(*) filter (where short and (side = 1 and abs(position - left_junction) <= 2 or side = 0 and abs(position - right_junction) <= 2)) as short_junction_clips,
    min(left_junction) as left_junction, min(right_junction) as right_junction, min(clip_mode) as clip_mode from rows_ join modes using (contig, cluster_start) group by contig, cluster_start
), candidates as (
  select *, left_clips + right_clips as junction_clips, (left_clips + right_clips >= 2 or mate_point is null) and clip_mode is not null as by_clips,
    case when left_clips >= 2 and right_clips >= 2 and left_junction - right_junction between 1 and 50 then left_junction - right_junction end as tsd from sums left join placed using (contig, cluster_start)
), profiles as (
  select * exclude (mate_first, mate_last), case when by_clips then clip_mode else coalesce(mate_point, cluster_start) end as breakpoint, case when not by_clips then mate_first end as mate_first, case when not by_clips then mate_last end as mate_last,
    list_filter([case when support < 2 then 'low_support' end, case when junction_clips < 2 then 'no_junction' end], lambda x: x is not null) as early from candidates
)"""

_COLUMNS = ["support", "distinct_starts", "start", "end", "clips", "left_side_clips", "right_side_clips", "unmapped_mates", "discordant_mates", "tail_clips", "polya_clips", "polyt_clips", "both_sides", "left_clips", "right_clips", "short_junction_clips", "junction_clips", "left_junction", "right_junction", "tsd", "breakpoint", "mate_first", "mate_last"]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.profiles(ca.clustered(signals(spark, sf_dir), _CALLING.window), _CALLING)


@query(f"""with {_CANDIDATES} select contig, cluster_start, {", ".join(f'"{c}"' for c in _COLUMNS)}, array_to_string(early, ';') as filters from profiles""")
def cluster_profile(spark, sf_dir):
    """Counts, junctions, duplicated site, breakpoint and first filters of each cluster of signals."""
    return _profiles(spark, sf_dir).select("contig", "cluster_start", *_COLUMNS, F.array_join("filters", ";").alias("filters"))


def _later(rows: DataFrame) -> DataFrame:
    """What typing, mates, depth and edges would add, made of the profile."""
    typed = F.col("junction_clips") >= 1
    c = F.col("cluster_start")
    return rows.select(
        "*",
        F.lit(20).alias("depth"),
        sc.signal_ratio(F.col("support"), F.lit(20)).alias("signal_ratio"),
        F.when(typed, F.when(c % 3 == 0, F.lit("ALU")).when(c % 3 == 1, F.lit("LINE1")).otherwise(F.lit("SVA"))).alias("family"),
        F.when(typed, F.concat(F.lit("sub"), (c % 7).cast("string"))).alias("subfamily"),
        F.when(typed, c % 2 == 0).alias("reverse"),
        F.when(typed, (c % 100).cast("int")).alias("element_start"),
        F.when(typed, (c % 100 + 80).cast("int")).alias("element_end"),
        F.when(typed, (95 + c % 6) / 100.0).alias("identity"),
        F.when(typed & (c % 4 != 0), F.col("junction_clips")).otherwise(0).cast("int").alias("typed_clips"),
        F.when(typed & (c % 4 != 0), F.col("short_junction_clips")).otherwise(0).cast("int").alias("short_typed_clips"),
        (typed & (c % 4 == 0)).alias("by_mates"),
        (F.col("unmapped_mates") + F.col("discordant_mates")).alias("checked_mates"),
        F.when(c % 5 < 3, F.col("unmapped_mates")).otherwise(0).cast("long").alias("mei_mates"),
        F.when((c % 5 < 3) & (F.col("unmapped_mates") > 0), (94 + c % 7) / 100.0).alias("mate_identity"),
        (c % 11 == 0).alias("reference_copy"),
        (c % 3).cast("long").alias("breakpoint_clips"),
        ((c % 2 == 1) & (F.col("clips") > 0)).alias("only_edges"),
    )


_JUDGED = f"""{_CANDIDATES}, later as (
  select *, support::double / 20 as signal_ratio, case when junction_clips >= 1 then ['ALU', 'LINE1', 'SVA'][cluster_start % 3 + 1] end as family, case when junction_clips >= 1 then 'sub' || (cluster_start % 7) end as subfamily,
    case when junction_clips >= 1 then (95 + cluster_start % 6)::double / 100 end as identity, case when junction_clips >= 1 and cluster_start % 4 <> 0 then junction_clips else 0 end as typed_clips, case when junction_clips >= 1 and cluster_start % 4 <> 0 then short_junction_clips else 0 end as short_typed_clips,
    junction_clips >= 1 and cluster_start % 4 = 0 as by_mates, unmapped_mates + discordant_mates as checked_mates, case when cluster_start % 5 < 3 then unmapped_mates else 0 end as mei_mates,
    case when cluster_start % 5 < 3 and unmapped_mates > 0 then (94 + cluster_start % 7)::double / 100 end as mate_identity, cluster_start % 11 = 0 as reference_copy, cluster_start % 3 as breakpoint_clips, cluster_start % 2 = 1 and clips > 0 as only_edges from profiles
), marked as (
  select *, mei_mates >= 4 and mei_mates::double / greatest(checked_mates, 1) >= 0.6::double as mostly from later
), alone_ as (
  select *, coalesce(family is not null and list_contains(early, 'no_junction') and not reference_copy and breakpoint_clips + junction_clips > 0 and mostly and case when by_mates then identity else mate_identity end >= 0.98::double, false) as alone,
    case when mei_mates > 0 then typed_clips else greatest(typed_clips - short_typed_clips, 0) end as counted from marked
), decided as (
  select *, case when alone then list_filter(early, lambda x: x <> 'no_junction') when mei_mates = 0 and junction_clips - short_junction_clips < 2 and not list_contains(early, 'no_junction') then list_concat(list_filter(early, lambda x: x = 'low_support'), ['no_junction']) else early end as known,
    counted >= 2 or counted >= 1 and tail_clips > 0 and mei_mates >= 2 or counted >= 1 and mostly and coalesce(mate_identity >= 0.96::double, false)
      or by_mates and not reference_copy and coalesce(identity >= 0.96::double, false) and tail_clips >= 2 and mei_mates >= 2 or alone as is_typed from alone_
), scored as (
  select *, 0.501::double + case when left_clips > 0 and right_clips > 0 then -0.193::double else 0.184::double end + case when tail_clips > 0 then 0.56::double else -0.251::double end + case when tsd is not null then -0.302::double else 0.056::double end
    + case when identity >= 0.98::double then 0.276::double else -0.577::double end + case when distinct_starts::double / support >= 0.7::double then 0.156::double else -0.152::double end
    + case when checked_mates > 0 and mei_mates::double / checked_mates >= 0.6::double then 0.665::double else -0.561::double end + case when signal_ratio >= 0.2::double then 0.156::double else -0.862::double end as s from decided
), rated as (
  select *, least(greatest(round(-10 * log10(1 / (1 + 10::double ** s))), 0), 99)::int as qual from scored
), judged as (
  select *, list_concat(known, list_filter([case when not is_typed then 'untyped' end, case when checked_mates > 0 and mei_mates < 0.3::double * checked_mates then 'non_mei_mates' end,
    case when only_edges and tail_clips = 0 and tsd is null and typed_clips = 0 then 'probe_edge' end, case when counted < 5 and signal_ratio < 0.15::double then 'low_ratio' end, case when qual < 5 then 'low_qual' end], lambda x: x is not null)) as filters from rated
), tiered as (
  select *, case when len(filters) > 0 then null when tail_clips = 0 or by_mates then 'low' when tsd is not null then 'high' else 'medium' end as confidence,
    case when junction_clips >= 1 and cluster_start % 2 = 0 then '-' when junction_clips >= 1 then '+' end as element_strand, cluster_start % 100 as e_start, cluster_start % 100 + 80 as e_end from judged
)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.judged(_later(_profiles(spark, sf_dir)), _CALLING)


@query(f"with {_JUDGED} select contig, cluster_start, qual, array_to_string(filters, ';') as filters, confidence from tiered")
def filter_list(spark, sf_dir):
    """All filters of each candidate in order, its quality and confidence."""
    return _rated(spark, sf_dir).select("contig", "cluster_start", "qual", F.array_join("filters", ";").alias("filters"), "confidence")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated candidates with a name for the contig, and no genotype."""
    rows = _rated(spark, sf_dir)
    return rows.select("*", F.concat(F.lit("c"), F.col("contig").cast("string")).alias("contig_name"), F.lit(None).cast("struct<call:string,quality:int>").alias("genotype"), F.lit(0).alias("alt_reads"), F.lit(0).alias("ref_reads"), F.lit(1).alias("junctions"))


_DOT = "coalesce({0}::varchar, '.')"


@query(f"""with {_JUDGED}, n as (select *, row_number() over (order by contig, cluster_start) as number from tiered)
select number, concat_ws(chr(9), 'MEI_' || number, 'c' || contig, breakpoint::varchar, {", ".join(_DOT.format(c) for c in ("left_junction", "right_junction", "tsd"))},
  case when polya_clips > polyt_clips then '+' when polya_clips < polyt_clips then '-' else '.' end, case when len(filters) = 0 then 'PASS' else array_to_string(filters, ';') end, coalesce(confidence, '.'), support::varchar, left_side_clips::varchar, right_side_clips::varchar, left_clips::varchar, right_clips::varchar, short_junction_clips::varchar,
  unmapped_mates::varchar, discordant_mates::varchar, polya_clips::varchar, polyt_clips::varchar, case when both_sides then 'yes' else 'no' end, distinct_starts::varchar, '20', printf('%.3f', round(signal_ratio * 1000) / 1000), "start"::varchar, "end"::varchar, coalesce(family, '.'), coalesce(subfamily, '.'), coalesce(element_strand, '.'),
  case when family is null then '.' else (e_start + 1)::varchar end, case when family is null then '.' else e_end::varchar end, case when family is null then '.' else printf('%.3f', round(identity * 1000) / 1000) end, typed_clips::varchar, short_typed_clips::varchar, checked_mates::varchar, mei_mates::varchar,
  '.', '.', '.', qual::varchar, '.', '.', '.', '.', case when family is null then '.' when by_mates then 'mates' else 'clips' end, case when mate_first is null then '.' else (mate_first - breakpoint) || ',' || (mate_last - breakpoint) end, breakpoint_clips::varchar) as line from n""")
def tsv_rows(spark, sf_dir):
    """Candidates as lines of the report's table, with its 46 columns."""
    return report.tsv(_reported(spark, sf_dir))


@query(f"""with {_JUDGED} select contig, cluster_start, concat_ws(';', 'SVTYPE=INS', case when family is not null then 'SVLEN=80' end, case when family is not null then 'MEINFO=' || concat_ws(',', subfamily, (e_start + 1)::varchar, e_end::varchar, element_strand) end, 'IMPRECISE',
  'CIPOS=' || (mate_first - breakpoint) || ',' || (mate_last - breakpoint), case when breakpoint_clips > 0 then 'BREAKPOINT_CLIPS=' || breakpoint_clips end, 'LEFT_JUNCTION=' || left_junction, 'RIGHT_JUNCTION=' || right_junction, 'TSD_LEN=' || tsd, 'CONFIDENCE=' || confidence,
  case when family is not null then 'TYPED_BY=' || case when by_mates then 'mates' else 'clips' end end, 'SUPPORT=' || support, 'JUNCTION_CLIPS=' || left_clips || ',' || right_clips, 'TAIL_CLIPS=' || polya_clips || ',' || polyt_clips, 'TYPED_CLIPS=' || typed_clips, 'MATES=' || unmapped_mates || ',' || discordant_mates,
  'MEI_MATES=' || checked_mates || ',' || mei_mates, 'DISTINCT_STARTS=' || distinct_starts, 'SIGNAL_RATIO=' || printf('%.3f', round(signal_ratio * 1000) / 1000)) as info, './.:.:.:.' as sample from tiered""")
def vcf_info(spark, sf_dir):
    """INFO and sample fields of candidates, as in the report's VCF."""
    rows = _reported(spark, sf_dir).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("assembled", "string"), ("tsd_bases", "string"), ("tail_run", "int"))])
    return rows.select("contig", "cluster_start", report.vcf_info().alias("info"), report.vcf_sample().alias("sample"))


@query(f"with {_JUDGED} select contig, cluster_start, case when junction_clips < 2 and unmapped_mates + discordant_mates >= 3 and signal_ratio >= 0.2::double then true when family is not null then junction_clips >= 2 else tail_clips > 0 end as checked, family is not null and junction_clips >= 2 as may_pass, alone as mate_only from tiered")
def candidate_gates(spark, sf_dir):
    """Which candidates' mates are looked at, which can pass, and which are insertions by their mates alone."""
    rows = _later(_profiles(spark, sf_dir))
    return rows.select("contig", "cluster_start", mates.checked().alias("checked"), ca.may_pass().alias("may_pass"), ca.mate_only().alias("mate_only"))


_SITES = f"""{_SPANS}, reads as (select o_custkey as contig, s as "start", e as "end", o_orderkey % 9 * 5 as left_clip, o_orderkey % 7 * 5 as right_clip, o_orderkey from spans),
sites as (select c_custkey as site, case when c_custkey % 5 <> 0 then 9300 + c_custkey % 13 * 20 end as l, case when c_custkey % 7 <> 0 then 9300 + c_custkey % 13 * 20 - c_custkey % 3 * 6 end as r from customer)"""


def _order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return order_spans(spark, sf_dir).select(F.col("o_custkey").alias("contig"), F.col("s").alias("start"), F.col("e").alias("end"), (o % 9 * 5).alias("left_clip"), (o % 7 * 5).alias("right_clip"), o)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    left, right = F.expr("9300 + c_custkey % 13 * 20"), F.expr("9300 + c_custkey % 13 * 20 - c_custkey % 3 * 6")
    return table(spark, sf_dir, "customer").select(c.alias("site"), c.alias("s_contig"), F.when(c % 5 != 0, left).alias("left"), F.when(c % 7 != 0, right).alias("right"))


@query(f"""with {_SITES}, spanned as (select *, least(l, r) as low, greatest(l, r) as high from sites),
pairs as (select site, low, high, "start", "end", coalesce(right_clip >= 15 and abs("end" - l) <= 5, false) as a, coalesce(left_clip >= 15 and abs("start" - r) <= 5, false) as b from spanned join reads on contig = site and "start" < high + 1 and greatest(low - 1, 0) < "end"),
counts as (select site, count_if(a)::bigint as alt_left, count_if(b)::bigint as alt_right, count_if("start" + 15 <= low and "end" >= high + 15 and not a and not b)::bigint as ref_reads from pairs group by site)
select site, coalesce(alt_left, 0) as alt_left, coalesce(alt_right, 0) as alt_right, coalesce(ref_reads, 0) as ref_reads from sites left join counts using (site)""")
def allele_counts(spark, sf_dir):
    """Order periods that speak for and against a site of each customer."""
    return ca.allele_counts(_sites(spark, sf_dir), _order_reads(spark, sf_dir), 15)


@query(f"""with {_SITES}, ends as (select contig, "start" as boundary from reads where left_clip >= 3 union all select contig, "end" from reads where right_clip >= 3),
votes as (select site, boundary, count(*) as votes from sites join ends on contig = site and boundary between 9200 and 9800 group by all having count(*) >= 2)
select site, boundary, votes from votes qualify row_number() over (partition by site order by votes desc, abs(boundary - 9500), boundary) = 1""")
def breakpoint_request(spark, sf_dir):
    """The day between two at which most order periods of each customer are clipped."""
    requests = _sites(spark, sf_dir).select("site", F.col("s_contig").alias("q_contig"), F.lit(9200).alias("first"), F.lit(9800).alias("last"), F.lit(9500).alias("estimate"))
    return junctions.breakpoints(requests, _order_reads(spark, sf_dir), ["site"])


@query(f"""with {_SITES}, w as (select site, l, r, 9000 as low, 9900 as high from sites),
told as (select *, o_orderkey % 10 = 0 as unmapped, "start" + 1 as one from reads),
pairs as (select site, o_orderkey, 'seq' || o_orderkey as seq, [case when not unmapped and right_clip > 0 and abs("end" - l) <= 5 then 'left' end, case when not unmapped and left_clip > 0 and abs("start" - r) <= 5 then 'right' end, case when unmapped and "start" >= low and "start" < high then 'inside' end] as roles
  from w join told on contig = site and "start" < high and low < case when unmapped then one else greatest("end", one) end where unmapped or left_clip > 0 or right_clip > 0),
tall as (select site, o_orderkey, seq, unnest(roles) as role from pairs)
select site, role, seq, (row_number() over (partition by site, role order by o_orderkey))::int as rank from tall where role is not null qualify rank <= 3""")
def junction_reads(spark, sf_dir):
    """The first three order periods for each role at a site of each customer."""
    o = F.col("o_orderkey")
    reads = _order_reads(spark, sf_dir).select("*", (o % 10 == 0).alias("unmapped"), F.concat(F.lit("seq"), o.cast("string")).alias("seq"))
    requests = _sites(spark, sf_dir).select("site", F.col("s_contig").alias("q_contig"), "left", "right", F.lit(9000).alias("low"), F.lit(9900).alias("high"))
    return junctions.junction_reads(requests, reads, ["site"], ["o_orderkey"], 3)


_HITS = """hits as (select p_brand, l_orderkey as voter, max(l_linenumber % 2 = 0) over (partition by p_brand, l_orderkey) as short, p_type as family, p_size as cid, p_type || p_size as name, l_linestatus = 'F' as reverse, floor(l_extendedprice)::bigint as score, floor(l_quantity)::bigint / 64 as identity, l_linenumber as element_start, l_linenumber + 40 as element_end
  from lineitem join part on l_partkey = p_partkey)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits: the order is the sequence, the part's type its family, type and size the consensus."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_type").alias("family"), F.col("p_size").alias("cid"), F.concat(F.col("p_type"), F.col("p_size").cast("string")).alias("name"))
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    hits = hits.select("p_brand", F.col("l_orderkey").alias("voter"), (F.col("l_linenumber") % 2 == 0).alias("even"), "family", "cid", "name", (F.col("l_linestatus") == "F").alias("reverse"), F.floor("l_extendedprice").cast("long").alias("score"), (F.floor("l_quantity") / 64.0).alias("identity"), F.col("l_linenumber").alias("element_start"), (F.col("l_linenumber") + 40).alias("element_end"))
    dealt = st.dealt(hits, ["p_brand", "voter"], lines.count())
    return dealt.withColumn("short", F.max("even").over(Window.partitionBy("p_brand", "voter"))).drop("even")


_SUBFAMILY = """by_cid as (
  select p_brand, family, cid, min(name) as name, sum(score) as total, sum(case when reverse then score else -score end) > 0 as reverse, avg(identity) as identity, min(element_start) as element_start, max(element_end) as element_end from hits join chosen using (p_brand, family) group by p_brand, family, cid
), best as (select * from by_cid qualify row_number() over (partition by p_brand order by total desc, cid) = 1)"""


@query(f"""with {_HITS}, own as (select p_brand, family, voter, max(score) as s, max(short) as short from hits group by all), sums as (select p_brand, family, sum(s) as total, count(*) as typed_clips, count_if(short)::bigint as short_typed_clips from own group by all),
chosen as (select * from sums qualify row_number() over (partition by p_brand order by total desc, family) = 1), {_SUBFAMILY}
select p_brand, family, name as subfamily, reverse, element_start, element_end, round(identity, 6) as identity, typed_clips, short_typed_clips from best join chosen using (p_brand, family)""")
def subfamily_vote(spark, sf_dir):
    """Family, subfamily, strand, identity and extent of each brand by its lines."""
    voted = typing.clip_vote(_hits(spark, sf_dir), ["p_brand"], "voter")
    return voted.drop("by_mates").withColumn("identity", F.round("identity", 6))


@query(f"""with {_HITS}, sums as (select p_brand, family, count(*) as mates, sum(score) as total from hits group by all),
chosen as (select p_brand, family, mates, total as family_score from sums qualify row_number() over (partition by p_brand order by mates desc, total desc, family) = 1), {_SUBFAMILY}
select p_brand, family, case when 2 * total > family_score then name else family end as subfamily, element_start, element_end, round(identity, 6) as identity, mates from best join chosen using (p_brand, family) where mates >= 2""")
def mate_vote(spark, sf_dir):
    """The element of each brand by the number of its lines."""
    return typing.mate_vote(_hits(spark, sf_dir), ["p_brand"]).withColumn("identity", F.round("identity", 6))


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as mates, which hold a piece of an item's sequence of varying length; items as windows."""
    items = dna(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("contig"), F.lit(0).alias("cluster_start"), F.col("seq").alias("window"))
    count = items.agg((F.max("contig") + 1).alias("n"))
    docs = dna(spark, sf_dir).crossJoin(F.broadcast(count)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("contig"), F.lit(0).alias("cluster_start"), "seq")  # one row
    joined = docs.join(items, ["contig", "cluster_start"])
    piece = F.expr("substring(window, 1 + cast(doc_id % 11 as int), 10 + cast(doc_id % 70 as int))")
    return joined.select("contig", "cluster_start", "doc_id", F.concat(F.expr("substring(seq, 1, 30 + cast(doc_id % 40 as int))"), F.when(F.col("doc_id") % 2 == 0, piece).otherwise(sq.reverse_complement(piece))).alias("seq")), items


def _dna_column(text: str) -> str:
    return f"translate(concat(md5(concat(coalesce({text}, ''), '0')), md5(concat(coalesce({text}, ''), '1')), md5(concat(coalesce({text}, ''), '2'))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _tailed(key: str) -> str:
    return f"case {key} % 3 when 0 then 'AAAAAAAAAAACAAAA' || d when 1 then d || 'TTTTTTTTTTTT' else d end"


@query(f"""with items as (select item_id as contig, {_tailed('item_id')} as win from (select item_id, {_dna_column('text')} as d from benchmark)),
docs as (select doc_id, doc_id % (select max(contig) + 1 from items) as contig, {_tailed('doc_id')} as seq from (select doc_id, {_dna_column('text')} as d from documents)),
pieces as (select doc_id, contig, win, seq, substr(win, 1 + doc_id % 11, 10 + doc_id % 70) as piece from docs join items using (contig)),
mates_ as (select doc_id, contig, win, substr(seq, 1, 30 + doc_id % 40) || case when doc_id % 2 = 0 then piece else translate(reverse(piece), 'ACGT', 'TGCA') end as m from pieces),
mk as (select doc_id, contig, least(k, translate(reverse(k), 'ACGT', 'TGCA')) as k from (select doc_id, contig, substr(m, i, 20) as k from (select *, unnest(range(1, length(m) - 18)) as i from mates_))),
wk as (select distinct contig, least(k, translate(reverse(k), 'ACGT', 'TGCA')) as k from (select contig, substr(win, i, 20) as k from (select *, unnest(range(1, length(win) - 18)) as i from items))),
share as (select doc_id, count(wk.k) >= 0.5::double * count(*) as local from mk left join wk on mk.contig = wk.contig and mk.k = wk.k group by doc_id)
select doc_id, coalesce(local, false) as local from mates_ left join share using (doc_id)""")
def shared_kmers(spark, sf_dir):
    """Documents of which half of the canonical 20-mers lie in their item's sequence."""
    found, windows = _shared(spark, sf_dir)
    return mates.local(found, windows, ["contig", "cluster_start", "doc_id"]).select("doc_id", "local")


@query()
def debruijn_contig(spark, sf_dir):
    """Contigs grown from pieces of each document's sequence, and where they leave the reference.

    Reads are pieces of 40 bases every 3 over a sequence in which an insert follows the first
    48 bases; the reference goes on without it.
    """
    rows = dna(spark, sf_dir).withColumn("hap", F.expr("concat(substring(seq, 1, 48), reverse(seq))"))
    pieces = F.expr("transform(sequence(0, (length(hap) - 40) div 3), i -> substring(hap, i * 3 + 1, 40))")
    none = F.array().cast("array<string>")
    columns = {"left_reads": F.concat(pieces, pieces), "right_reads": none, "inside": none, "window": F.col("seq"), "start": F.lit(0).cast("long"), "left": F.lit(48).cast("long"), "right": F.lit(None).cast("long")}
    return rows.select("doc_id", asm.assembled(columns).alias("a")).select("doc_id", "a.left_junction", "a.left_contig", "a.left_insert", "a.tail_base", "a.tail_length")
