"""DuckDB SQL with the results of queries of this subpackage."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_line_dedup"] = r"""
with lines as (
  select doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as bare
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), keyed as (
  select doc_id, i, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), frequent as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by doc_id
"""

ORACLE_SQL["op9_warc"] = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first_page from p where payload_bytes >= 100 group by payload_digest
)
select page_id, payload_bytes, p.payload_digest,
       case when first_page < page_id then 'revisit' else 'response' end as record_type,
       case when first_page < page_id then first_page end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""

_RULES = [("symbols", "n_symbols / greatest(n_words, 1)"), ("dup_lines", "n_dup_lines / greatest(n_lines, 1)"), ("repeats", "n_repeat_words / greatest(n_words, 1)"), ("upper", "n_upper / greatest(word_chars, 1)"), ("long_words", "word_chars / greatest(n_words, 1)"), ("short_words", "word_chars / greatest(n_words, 1)")]

ORACLE_SQL["op6_quality_rules"] = rf"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d
), windows as (
  select rid, k, count(*) over (partition by rid, array_to_string(words[k:k + 4], ' ')) as n
  from (select rid, words, unnest(range(1, len(words) - 3)) as k from w where len(words) >= 5)
), covered as (
  select rid, count(distinct k + j) as n_repeat_words from windows, range(5) r(j) where n > 1 group by rid
), lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), stats as (
  select rid, doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(regexp_extract_all(text, '[A-Z]'))::bigint as n_upper
  from w left join covered using (rid) left join lines using (rid)
), cells as (
  select rid, lang, source, rule, name, ceil(ln(value) / ln(1.01::double))::int as cell
  from (select rid, lang, source, unnest([{", ".join(f"{{'rule': {i}, 'name': '{n}', 'value': {v.replace(' /', '::double /')}}}" for i, (n, v) in enumerate(_RULES))}], recursive := true) from stats) where value > 0
), counted as (
  select lang, source, rule, cell, count(*) as n from cells group by all
), own as (
  select lang, source, rule, max(total) as n, min(cell) filter (upto >= 0.25 * total) as low, min(cell) filter (upto >= 0.75 * total) as high
  from (select *, sum(n) over (partition by lang, source, rule order by cell) as upto, sum(n) over (partition by lang, source, rule) as total from counted) group by lang, source, rule
), by_lang as (
  select lang, rule, max(total) as n, min(cell) filter (upto >= 0.25 * total) as low, min(cell) filter (upto >= 0.75 * total) as high
  from (select *, sum(n) over (partition by lang, rule order by cell) as upto, sum(n) over (partition by lang, rule) as total from (select lang, rule, cell, sum(n) as n from counted group by all)) group by lang, rule
), by_all as (
  select rule, min(cell) filter (upto >= 0.25 * total) as low, min(cell) filter (upto >= 0.75 * total) as high
  from (select *, sum(n) over (partition by rule order by cell) as upto, sum(n) over (partition by rule) as total from (select rule, cell, sum(n) as n from counted group by all)) group by rule
), picked as (
  select a.lang, a.source, a.rule,
         case when a.n >= 50 then a.low when b.n >= 50 then b.low else c.low end as low,
         case when a.n >= 50 then a.high when b.n >= 50 then b.high else c.high end as high,
         greatest(case when a.n >= 50 then a.high - a.low end, case when b.n >= 50 then b.high - b.low else c.high - c.low end) as spread
  from own a join by_lang b on a.lang is not distinct from b.lang and a.rule = b.rule join by_all c on a.rule = c.rule
), broken as (
  select rid, string_agg(name, ',' order by c.rule) as failed_rules
  from cells c join picked p on c.lang is not distinct from p.lang and c.source is not distinct from p.source and c.rule = p.rule
  where (c.rule < 5 and cell > high + 2.5 * spread) or (c.rule = 5 and cell < low - 2.5 * spread)
  group by rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and failed_rules is null as kept, coalesce(failed_rules, '') as failed_rules
from stats left join broken using (rid)
"""

ORACLE_SQL["op11_mixing"] = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(concat(coalesce(doc_id::varchar, ''), ' ', coalesce(text, ''))), 1, 15))::bigint as place
  from documents
), curves(curve, weight, t0, t1, w0, w1, upto) as (
  values (0, 5.0::double, 0.0::double, 1.0::double, 7.5::double, 2.5::double, 5.0::double), (1, 2.0::double, 0.0::double, 1.0::double, 2.0::double, 2.0::double, 2.0::double),
         (2, 1.0::double, 0.0::double, 0.5::double, 0.25::double, 0.75::double, 0.25::double), (2, 1.0::double, 0.5::double, 1.0::double, 0.75::double, 2.25::double, 1.0::double)
), s as (
  select source, source_size, curve, (select max(weight) from curves c where c.curve = r.curve) as weight
  from (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as curve from d group by source) r
), level(level, held) as (
  select 0.0::double, -1::bigint
  union all
  select (1.5::double * any_value(total) - 2.0::double * coalesce(sum(source_size) filter (where over), 0)) / (sum(weight) filter (where not over)), count(*) filter (where over)
  from (select s.*, level, held, weight * level > source_size * 2.0::double as over, (select sum(source_size) from s)::double as total from s, level)
  group by held having count(*) filter (where over) > any_value(held) and count(*) filter (where not over and weight > 0) > 0
), t as (
  select *, floor(target + 0.5::double)::bigint as goal
  from (select *, least(weight * (select arg_max(level, held) from level), source_size * 2.0::double) as target from s)
), laid as (
  select *, coalesce(sum(size) over (partition by source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d
), copies as (
  select l.doc_id, l.size, t.source_size, t.target, t.curve, t.weight, t.goal, l.start,
         greatest(least(l.size, t.goal - l.start), 0) as first, greatest(least(l.size, t.goal - t.source_size - l.start), 0) as second
  from laid l join t on l.source is not distinct from t.source
), placed as (
  select *, (start + first / 2.0::double) / goal::double * weight as area from copies where first > 0
), seg as (
  select p.*, c.t0, c.t1, c.w0, c.w1, c.t1 - c.t0 as span, greatest(area - (c.upto - (c.w0 + c.w1) / 2.0::double * (c.t1 - c.t0)), 0.0::double) as inside
  from placed p join curves c on c.curve = p.curve and c.upto >= p.area
  where not exists (select 1 from curves b where b.curve = p.curve and b.upto >= p.area and b.upto < c.upto)
)
select doc_id, size, source_size, target, first + second as taken,
       t0 + least(2.0::double * inside / (w0 + sqrt(w0 * w0 + 2.0::double * ((w1 - w0) / span) * inside)), span) as position
from seg
union all
select doc_id, size, source_size, target, 0, null from copies where first = 0
"""

ORACLE_SQL["op12_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.q, r.q)::bigint as score
  from v a, v r where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

ORACLE_SQL["op13_collocations"] = r"""
with pieces as (
  select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece
  from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), totals as (
  select lang, sum(len(words))::bigint as n from w group by lang
), counts as (
  select lang, size, phrase, count(*)::bigint as n
  from (select lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) as phrase from w, range(1, 6) s(size) where len(words) >= size)
  group by lang, size, phrase having count(*) >= 100
), cuts as (
  select lang, phrase, n as a, k, array_to_string(p[1:k], ' ') as head, array_to_string(p[k + 1:], ' ') as rest
  from (select *, string_split(phrase, ' ') as p, unnest(range(1, size)) as k from counts where size > 1)
), scored as (
  select c.*, x.n as l, y.n as r, t.n as n, ((1000::hugeint * a * t.n) // (x.n::hugeint * y.n))::bigint as score
  from cuts c join counts x on c.lang = x.lang and c.head = x.phrase join counts y on c.lang = y.lang and c.rest = y.phrase join totals t on c.lang = t.lang
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_parts as (
  select lang, array_to_string(p[i:i + w - 1], ' ') as phrase, max(n) as longer
  from (select c.lang, c.n, c.size, string_split(c.phrase, ' ') as p, w, unnest(range(1, c.size - w + 2)) as i from counts c, range(2, 5) s(w) where w < c.size)
  group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best left join inner_parts using (lang, phrase)
where longer is null or 100 * longer < 100 * a
qualify rank <= 2000
"""
