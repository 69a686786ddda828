"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from scriptorium.llm import quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LM_SCORING = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
p as (select doc_id, i, ws[i] as c, ws[i - 1] as b, ws[i - 2] as a from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)),
n as (select doc_id, i,
    count(*) over (partition by c) - count(*) over (partition by c, doc_id) as r1,
    case when i > 1 then count(*) over (partition by i > 1, b, c) - count(*) over (partition by i > 1, b, c, doc_id) end as r2,
    case when i > 2 then count(*) over (partition by i > 2, a, b, c) - count(*) over (partition by i > 2, a, b, c, doc_id) end as r3,
    count(*) over () - count(*) over (partition by doc_id) as others from p),
l as (select *, lag(r1) over (partition by doc_id order by i) as c1, lag(r2) over (partition by doc_id order by i) as c2 from n),
m as (select doc_id, sum(round(1000000 * (case
    when r3 > 0 then log10(r3 / c2)
    when r2 > 0 then least(i - 2, 1) * log10(0.4::double) + log10(r2 / c1)
    when r1 > 0 then least(i - 1, 2) * log10(0.4::double) + log10(r1 / others)
    else least(i - 1, 2) * log10(0.4::double) + log10(1 / (others + 1)) end))::bigint) as micro from l group by doc_id)
select doc_id, len(ws) as n_words, case when len(ws) > 0 then round(micro::double / len(ws), 0) / 1000000 end as score, coalesce(micro, 0)::double / 1000000 as total
from w left join m using (doc_id)"""

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

QUALITY_RULES = f"""
with w as (select doc_id, coalesce(text, '') as text, {_WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
g as (select doc_id, i, hash(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) as h from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
t as (select doc_id, i from g qualify count(*) over (partition by doc_id, h) > 1),
r as (select doc_id, count(distinct i + k) as n from t, (select unnest(range(5)) as k) group by doc_id),
f as (select doc_id, len(ws) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    length(text) - length(translate(text, '!|', '')) as marks, len(list_filter(ws, lambda x: x in ({_STOPS}))) as stops, greatest(len(ls), 1) as n_lines from w left join r using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, greatest(n_words, 1) as per from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and n_words >= 10 and n_words <= 1000000 and word_chars / per >= 2.0 and word_chars / per <= 14.0 and n_symbols / per <= 0.2 and marks / per <= 0.5 and stops / per >= 0.04 and n_dup_lines / n_lines <= 0.3 as kept
from b"""

MIXING = f"""
with d as (select doc_id, source, len({_WORDS})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, list_extract([5.0, 2.0, 1.0]::double[], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int) as weight from d group by source),
o as (select *, source_size * 2.0::double as most, row_number() over (order by source_size * 2.0::double / weight, source) as k from s),
c as (select *, sum(most) over (order by k) as taken, sum(weight) over () - sum(weight) over (order by k) as rest, sum(source_size) over () as total from o),
v as (select 0 as k, 1.5::double * any_value(total) / sum(weight) as level from c union all select k, case when rest > 0 then (1.5::double * total - taken) / rest end from c),
f as (select min(v.k) as k from v left join c on c.k = v.k + 1 where c.k is null or c.most > c.weight * v.level),
t as (select source, source_size, case when c.k <= f.k then most else weight * v.level end as target from c, f join v on v.k = f.k),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * case when size > 0 then floor(rate)::bigint + (('0x' || substr(md5(doc_id || ':mix'), 1, 8))::bigint / 4294967296.0::double < rate - floor(rate))::bigint else 0 end)::bigint as taken from r"""

_ESCAPES = r"len(regexp_extract_all({0}, '[<\[]\\*/?(s>|INST\]|ROLE\]|TURN\])'))"
CHAT_FORMAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as first from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(text) + {_ESCAPES.format('text')} + case when first then 16 + length(role) + {_ESCAPES.format('role')} + case when role = 'assistant' then 4 else 17 end else 6 end)::bigint as formatted_chars
from n group by conv_id"""

VECTOR_SEARCH = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, rank, vec_id, score from (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint as score,
    row_number() over (partition by a.vec_id order by list_inner_product(a.v, b.v) desc, b.vec_id)::int as rank from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) where rank <= 10"""

VECTOR_DEDUP = """
with recursive v as (select vec_id, embedding::double[] as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a), c as (select a, min(b) as b from r group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, b)::bigint as component_id, coalesce(b >= vec_id, true) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id"""

FILL_MIDDLE = """
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select doc_id, text, t, len(t) as n, ('0x' || h[1:8])::bigint % (len(t) + 1) as x, ('0x' || h[9:16])::bigint % (len(t) + 1) as y, ('0x' || h[17:24])::bigint % 100 as z, ('0x' || h[25:32])::bigint % 100 as w from d),
p as (select doc_id, text, n, array_to_string(t[1:least(x, y)], '') as prefix, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') as middle, array_to_string(t[greatest(x, y) + 1:], '') as suffix,
    case when text = '' or regexp_matches(text, '<[PSM]>') or z >= 90 then 'plain' when w < 20 then 'spm' else 'psm' end as form from k)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p"""

ORACLES = {"op1_lm_scoring": LM_SCORING, "op4_quality_rules": QUALITY_RULES, "op5_mixing": MIXING, "op7_chat_format": CHAT_FORMAT, "op9_vector_search": VECTOR_SEARCH, "op11_vector_dedup": VECTOR_DEDUP, "op12_fill_middle": FILL_MIDDLE}
