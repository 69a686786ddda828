"""Fragments of DuckDB SQL that several twins share."""

from __future__ import annotations

from scriptorium.functions.text import WS


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def normalised(x: str) -> str:
    return collapsed(f"lower(coalesce({x}, ''))")


def tokens(x: str) -> str:
    return f"greatest(1, length({x}) // 4)::int"


#: The Markdown view of the conversations: a heading for each turn, a fence for assistants, a table every third turn.
MARKDOWN = """
    select conv_id, string_agg('## Turn ' || turn || ' ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '')
        || case when role = 'assistant' then chr(10) || chr(10) || '```' || chr(10) || 'code ' || turn || chr(10) || '```' else '' end
        || case when turn % 3 = 0 then chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' else '' end, chr(10) || chr(10) order by turn, text) as body
    from conversations group by conv_id"""
VIEW = f"select conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || body as text from ({MARKDOWN})"
LINES = f"""
    select conv_id, i as line, ls[i + 1] as content, length(array_to_string(ls[1:i], chr(10))) + case when i > 0 then 1 else 0 end as start_at
    from (select conv_id, string_split(text, chr(10)) as ls from ({VIEW})), lateral (select unnest(range(len(ls))) as i)"""

#: The same with a comment line in each fence, so that a heading mark stands where no heading is; its lines tell fences and tables.
FENCED_VIEW = VIEW.replace("'code '", "'# code '")
BLOCK_LINES = f"""
    select conv_id, line, content, n % 2 = 1 or starts_with(content, '```') as fence, (n + 1) // 2 as f, n % 2 = 0 and regexp_matches(content, '^\\|[^\\n]+\\|$') as bar from (
        select conv_id, line, content, count(*) filter (where starts_with(content, '```')) over (partition by conv_id order by line) as n
        from (select conv_id, unnest(ls) as content, unnest(range(len(ls))) as line from (select conv_id, string_split(regexp_replace(text, '(?s)(```.*?```)', chr(10) || '\\1' || chr(10), 'g'), chr(10)) as ls from ({FENCED_VIEW}))))"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def stripped(x: str) -> str:
    return _STRIP.format(x)


SECTIONS = f"""
    select conv_id, row_number() over (partition by conv_id order by part, is_head desc) - 1 as section, heading, text, is_head,
        case when is_head then 'heading' when lone and has_fence then 'code_fence' when lone then 'table' else 'text' end as kind from (
        select conv_id, part, is_head, max(heading) as heading, case when is_head then string_agg(content, chr(10) order by line) else {stripped('string_agg(content, chr(10) order by line)')} end as text,
            not is_head and count(*) filter (where not fence and not bar and trim(content) <> '') = 0 and count(distinct f) filter (where fence) + max(bar::int) = 1 as lone, bool_or(fence) as has_fence
        from (select *, count(*) filter (where is_head) over (partition by conv_id order by line) as part, last_value(case when is_head then trim(regexp_extract(content, '^#+\\s+(.+)$', 1)) end ignore nulls) over (partition by conv_id order by line) as heading
            from (select *, not fence and regexp_matches(content, '^#{{1,3}}\\s+\\S') as is_head from ({BLOCK_LINES})))
        group by conv_id, part, is_head) where text <> ''"""


def semantic(most: int, least: int) -> str:
    """Common tables of semantic chunks: the last one, `chunks`, has conv_id, chunk, text, heading, boundary, has_table."""
    context = "case when heading = '' then 0 else " + tokens("'[Contesto: ' || heading || ']' || chr(10)") + " end"
    return f"""with recursive sections as materialized (select conv_id, section, coalesce(heading, '') as heading, text, kind, {tokens('text')} as n, {context} as c from ({SECTIONS.replace("heading, text, is_head,", "coalesce(heading, '') as heading, text, is_head,", 1)})),
    fold as (select conv_id, section, 0 as chunk, n::bigint as total from sections where section = 0
      union all select s.conv_id, s.section, case when total + n > {most} and total >= {least} then chunk + 1 else chunk end, case when total + n > {most} and total >= {least} then c + n else total + n end
        from fold join sections s on s.conv_id = fold.conv_id and s.section = fold.section + 1),
    joined as (select conv_id, chunk, string_agg(text, chr(10) order by section) as body, arg_min(heading, section) as first, arg_max(heading, section) as last_own, bool_or(kind = 'table') as has_table,
        arg_max(kind, section) filter (where kind in ('code_fence', 'table')) as lone from fold join sections using (conv_id, section) group by conv_id, chunk),
    chunks as (select conv_id, chunk, {stripped("case when chunk > 0 and first <> '' then '[Contesto: ' || first || ']' || chr(10) || chr(10) || body else body end")} as text,
        coalesce(lead(first) over (partition by conv_id order by chunk), last_own) as heading, coalesce(last_value(lone ignore nulls) over (partition by conv_id order by chunk), 'paragraph') as boundary, has_table from joined)"""


def folded(source: str, most: str, label: str) -> str:
    """Rows (conv_id, n from 1, title, text) folded: a row joins the group before it where `most` holds of the group's text t,
    its last member's text l and the row's own; a query of conv_id, section, title, digest."""
    return f"""with recursive r as materialized ({source}),
    f as (select conv_id, n, 0 as g, text as t, text as l from r where n = 1 union all select r.conv_id, r.n, case when {most} then g else g + 1 end, case when {most} then t || chr(10) || chr(10) || r.text else r.text end, r.text
        from f join r on r.conv_id = f.conv_id and r.n = f.n + 1)
    select conv_id, g::int as section, {label} as title, md5(arg_max(t, n)) as digest from f join r using (conv_id, n) group by conv_id, g"""
