"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from plectrum.llm.chat import PROBE, Template
from plectrum.llm.fill_middle import MIDDLE, PREFIX, SALT, SUFFIX
from plectrum.llm.jaccard import PERCENT, WORDS
from plectrum.llm.lines import MIN_PAGES, RATIO
from plectrum.llm.quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(map(_quoted, values))


def _chat(t: Template = Template()) -> str:
    """Turns in order, written with the template; the automaton's verdict from each role and the one before it."""
    escaped, named = "{}", "{}"
    for plain, code in t.codes:
        escaped = f"replace({escaped}, {_quoted(plain)}, {_quoted(code)})"
    for plain, code in (*t.codes, *t.role_codes):
        named = f"replace({named}, {_quoted(plain)}, {_quoted(code)})"
    labels = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in t.labels.items())
    legal = " ".join(f"when {_quoted(state)} then role in ({_listed(nexts)})" for state, nexts in t.follows.items())
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
  select -7, 0, 'user', {_quoted(PROBE)} union all select -7, 1, 'assistant', {_quoted(PROBE)}),
placed as (
  select *, row_number() over o - 1 as place, coalesce(lag(role) over o, '') as before, lead(role) over o is null as last
  from rows window o as (partition by conv_id order by turn nulls first, role, text)),
told as (
  select *, {_quoted(t.head)} || case role {labels} else {_quoted(t.raw_label)} || {named.format("role")} end || {_quoted(t.after_role)} || {escaped.format("text")} || {_quoted(t.end)} as said,
    case before {legal} else false end as legal from placed),
whole as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by place) as told, string_agg(case when role in ({_listed(t.loss_roles)}) then text else '' end, '' order by place) as loss,
    sum(length(said))::bigint as formatted_chars, min(case when not legal then place end) as first_bad_turn, bool_or(last and role in ({_listed(t.final)})) as ends_well from told group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, first_bad_turn is null and ends_well as valid, first_bad_turn from whole
"""


def _quality() -> str:
    """Counts by lists of words, windows and lines; a word is repeated if a window that holds it is found twice."""
    ratio = {
        "n_words": "n_words", "repeat_word_ratio": "n_repeat_words / n", "mean_word_chars": "word_chars / n", "symbol_ratio": "n_symbols / n", "exclaim_ratio": "n_exclaims / n",
        "stop_word_ratio": "n_stop_words / n", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    tests = [f"{ratio[r.metric]} >= {r.low}" for r in RULES if r.low is not None] + [f"{ratio[r.metric]} <= {r.high}" for r in RULES if r.high is not None]
    return f"""
with d as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from documents),
g as (select row, unnest(range(1, len(w) - 1)) as i, w from d where len(w) > 2),
h as (select row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from g),
twice as (select row, i from h qualify count(*) over (partition by row, gram) > 1),
covered as (select row, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by row),
m as (
  select doc_id, len(w) as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, len(lines) as n_lines, length(text) - length(replace(text, '!', '')) as n_exclaims, len(list_filter(w, lambda x: x in ({_listed(STOP_WORDS)}))) as n_stop_words
  from d left join covered using (row)),
b as (select *, greatest(n_words, 1)::double as n, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(tests)} as kept, n_lines, n_exclaims, n_stop_words from b
"""


def _jaccard() -> str:
    """Shared shingles by a join on the shingle; components by reaching out along links."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(WORDS))
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
s as (select doc_id, unnest(case when len(w) >= {WORDS} then list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: {gram})) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= {PERCENT} * (a.n + b.n - k)),
e as (select x, y from l union all select y, x from l),
reach as (select doc_id, doc_id as top from d union select e.x, r.top from reach r join e on e.y = r.doc_id),
c as (select doc_id, min(top) as component_id from reach group by 1),
k as (select x as doc_id, count(*) as n_links from e group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, coalesce(n_links, 0) as n_links from d join c using (doc_id) left join n using (doc_id) left join k using (doc_id)
"""


#: A line with a character other than space and the ASCII line and tab controls.
_REAL = r"regexp_matches(l, '[^\x20\x09-\x0D]')"

LINES = f"""
with pages as (
  select row_number() over () as page, doc_id, source, coalesce(source, chr(1)) as host, text,
         string_split(text, chr(10)) as lines
  from documents),
each as (
  select distinct page, host, l from (select page, host, unnest(lines) as l from pages) where {_REAL}),
counted as (select host, l, count(*) as n from each group by host, l),
totals as (select host, count(*) as total from pages group by host),
bad as (
  select host, list(l) as drops from counted join totals using (host)
  where n >= {MIN_PAGES} and n > {RATIO} * total group by host)
select doc_id, source,
       case when text is null or drops is null then text
            else array_to_string(list_filter(lines, lambda l: not list_contains(drops, l)), chr(10)) end as text,
       coalesce(len(lines), 0) as n_lines,
       case when text is null or drops is null then 0
            else len(lines) - len(list_filter(lines, lambda l: not list_contains(drops, l))) end as n_dropped
from pages left join bad using (host)
"""


def _fill_middle() -> str:
    """Lines from a split, cuts by sums of line lengths."""
    number = lambda i: f"('0x' || substr(digest, {1 + 8 * i}, 8))::bigint"
    before = lambda k: f"(case when {k} = n then length(t) else {k} + coalesce(list_sum(list_transform(s[1:{k}], lambda x: length(x))), 0) end)::bigint"
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as s, sha256('{SALT}:' || coalesce(doc_id::varchar, '')) as digest from documents),
l as (select *, (len(s) - (s[-1] = '')::int)::bigint as n, {number(0)} as h1, {number(1)} as h2, {number(3)} as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from l),
p as (select *, {before("a")} as lo, {before("b")} as hi,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c),
o as (select *, '{PREFIX}' || substr(t, 1, lo) as x, '{SUFFIX}' || substr(t, hi + 1) as y, '{MIDDLE}' || substr(t, lo + 1, hi - lo) as z from p)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then x || y || z else y || x || z end) as output_sha256, sha256(t) as restored_sha256 from o
"""


def sql() -> dict[str, str]:
    return {"op1_chat_format": _chat(), "op3_quality_rules": _quality(), "op7_line_dedup": LINES, "op10_ngram_jaccard": _jaccard(), "op12_fill_middle": _fill_middle()}
