"""DuckDB SQL for the registered queries: another way to the same rows."""

from __future__ import annotations

from plectrum.functions import language

# The language's words, written out for the twins alone.
_TO_TWENTY_NINE = (
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve"
).split()
_TENS = "diez veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
_HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
_MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
_FIRST_TO_SEVENTH = "primero segundo tercero cuarto quinto sexto séptimo".split()

#: ECMAScript white space for RE2.
WS = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_EVENTS = "(select event_id, user_id, event_type, value, epoch_us(ts) // 1000 as ms from events)"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g'))"


def _units(x: str) -> str:
    """UTF-16 units: characters beyond the basic plane count twice."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _score(markers: list[str]) -> str:
    return " + ".join(f"(length(hay) - length(replace(hay, ' {m} ', ''))) // {len(m) + 2}" for m in markers)


def _cardinal(n: str) -> str:
    """Words below a million by lists of the language's own words."""
    def below_hundred(x: str) -> str:
        ten = f"({_quoted(_TENS)})[{x} // 10]"
        return f"(case when {x} < 30 then ({_quoted(_TO_TWENTY_NINE)})[{x} + 1] when {x} % 10 = 0 then {ten} else {ten} || ' y ' || ({_quoted(_TO_TWENTY_NINE)})[{x} % 10 + 1] end)"

    def below_thousand(x: str) -> str:
        h, r = f"({x} // 100)", f"({x} % 100)"
        return (
            f"(case when {x} < 100 then {below_hundred(x)} when {x} = 100 then 'cien' when {r} = 0 then ({_quoted(_HUNDREDS)})[{h}] "
            f"when {r} = 1 and {h} in (5, 7, 9) then ({_quoted(_HUNDREDS)})[{h}] || ' y uno' else ({_quoted(_HUNDREDS)})[{h}] || ' ' || {below_hundred(r)} end)"
        )

    t, r = f"({n} // 1000)", f"({n} % 1000)"
    head = f"case when {t} = 1 then 'mil' else {below_thousand(t)} || ' mil' end"
    return f"(case when {n} < 1000 then {below_thousand(n)} when {r} = 0 then {head} else {head} || ' ' || {below_thousand(r)} end)"


LISTEN_TIMED = f"""
timed as (
  select *, least(3.0, greatest(1.0, {_units("coalesce(text, '')")} * 0.01::double)) as duration,
    case when lead(turn) over (partition by conv_id order by turn) is null then 0.0::double
         when regexp_matches(list_extract(string_split(text, ' '), -1), '[.!?\\n]$') then 0.4::double
         when regexp_matches(list_extract(string_split(text, ' '), -1), '[,;:]$') then 0.05::double else 0.1::double end as gap
  from conversations),
placed as (
  select *, coalesce(sum(duration + gap) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as start from timed)
"""

BLOCKS = f"""
lines as (
  select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) as raw,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), 1) as i from documents),
clean as (select doc_id, i, {trim("raw")} as l from lines),
runs as (select *, sum(case when l = '' then 1 else 0 end) over (partition by doc_id order by i) as g from clean),
blocks as (
  select doc_id, min(i) as a, max(i) as b, string_agg(l, ' ' order by i) as text from runs where l <> '' group by doc_id, g),
numbered as (select *, row_number() over (partition by doc_id order by a) - 1 as ord from blocks)
"""

_DICE = r"""
{a} as (select {id} as id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) as w from {table})
"""


def sql() -> dict[str, str]:
    return {
        "doc_blocks_txt": f"with {BLOCKS} select doc_id, ord, text, 'L' || a || '-L' || b as source_ref from numbered",
        "literal_plan": f"with {BLOCKS} select doc_id, 's' || ord as segment_id, text as spoken_text, false as muted from numbered",
        "chrome_repeat": """
with b as (select user_id as doc_id, ms // 86400000 as page, event_id as ord, event_type = 'error' as head,
  ' ' || upper(event_type[1]) || event_type[2:] || '  ' || ms // 3600000 % 8 as text, event_type || ' ' || ms // 3600000 % 8 as key from (select *, epoch_us(ts) // 1000 as ms from events)),
pages as (select doc_id, count(distinct page) as n from b group by 1),
firsts as (select *, row_number() over (partition by doc_id, key, page order by ord) as r from b),
wide as (select doc_id, key from firsts join pages using (doc_id) where r = 1 group by doc_id, key, n having count(*) >= greatest(3, ceil(n * 0.25)))
select doc_id, ord, text from firsts semi join wide using (doc_id, key) where r = 1 and not head""",
        "page_number_lines": """
select l_returnflag, count(*) as n from lineitem where l_partkey % 5 in (0, 1, 2) group by 1""",
        "lang_detect": f"""
with h as (select doc_id, lang, ' ' || regexp_replace(lower(coalesce(text, '')), '{WS}+', ' ', 'g') || ' ' as hay from documents),
s as (select doc_id, lang, {_score(language.SPANISH)} + 2 * (length(hay) - length(regexp_replace(hay, '[{language.ACCENTS}]', '', 'g'))) as es_score, {_score(language.ENGLISH)} as en_score from h)
select doc_id, lang, es_score, en_score, case when es_score >= en_score then 'es' else 'en' end as detected from s""",
        "lang_confusion": f"""
with h as (select lang, ' ' || regexp_replace(lower(coalesce(text, '')), '{WS}+', ' ', 'g') || ' ' as hay from documents),
s as (select lang, {_score(language.SPANISH)} + 2 * (length(hay) - length(regexp_replace(hay, '[{language.ACCENTS}]', '', 'g'))) as a, {_score(language.ENGLISH)} as b from h)
select lang, case when a >= b then 'es' else 'en' end as detected, count(*) as n from s group by 1, 2""",
        "dice_benchmark": f"""
with {_DICE.format(a="da", id="doc_id", table="documents")}, {_DICE.format(a="ib", id="item_id", table="benchmark")},
a as (select id, w, count(*) as n from da group by id, w), b as (select id, w, count(*) as n from ib group by id, w),
sa as (select id, sum(n) as s from a group by id), sb as (select id, sum(n) as s from b group by id),
m as (select a.id as x, b.id as y, sum(least(a.n, b.n)) as shared from a join b using (w) group by 1, 2)
select x as left_id, y as right_id, floor(2 * shared / (sa.s + sb.s) * 10000 + 0.5) / 10000 as dice
from m join sa on sa.id = x join sb on sb.id = y where 2 * shared / (sa.s + sb.s) >= 0.55""",
        "dice_turns": r"""
with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations),
p as (select * from t where before is not null),
a as (select conv_id, turn, w, count(*) as n from (select conv_id, turn, unnest(regexp_extract_all(lower(before), '[\p{L}\p{N}]+')) as w from p) group by all),
b as (select conv_id, turn, w, count(*) as n from (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from p) group by all),
sa as (select conv_id, turn, sum(n) as s from a group by all), sb as (select conv_id, turn, sum(n) as s from b group by all),
m as (select a.conv_id, a.turn, sum(least(a.n, b.n)) as shared from a join b using (conv_id, turn, w) group by all)
select p.conv_id, p.turn, case when coalesce(sa.s, 0) + coalesce(sb.s, 0) = 0 then 1.0
  else floor(2 * coalesce(shared, 0) / (coalesce(sa.s, 0) + coalesce(sb.s, 0)) * 10000 + 0.5) / 10000 end as dice
from p left join sa using (conv_id, turn) left join sb using (conv_id, turn) left join m using (conv_id, turn)""",
        "exact_norm": f"""
with l as (select doc_id, lang, {_norm("unnest(string_split(coalesce(text, ''), chr(10)))")} as key from documents),
k as (select key from l where key <> '' group by 1 having count(distinct lang) > 1)
select distinct doc_id from l where key in (select key from k)""",
        "pctl_floor": """
with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(value) filter (k = least(n, floor(n * 0.5) + 1)) as p50, max(value) filter (k = least(n, floor(n * 0.95) + 1)) as p95 from r group by event_type""",
        "mode_first": """
with c as (select l_returnflag, l_quantity as mode, count(*) as n, min(l_orderkey * 100 + l_linenumber) as f from lineitem group by all)
select l_returnflag, mode, n from (select *, row_number() over (partition by l_returnflag order by n desc, f) as r from c) where r = 1""",
        "rate_limit": f"""
with e as (select *, ms // 1000 as s from {_EVENTS}),
w as (select event_id, s, s // 3600 * 3600 as window_start, row_number() over (partition by user_id, s // 3600 order by s, event_id) as place from e)
select event_id, window_start, place, place <= 1 as allowed, case when place <= 1 then 0 else window_start + 3600 - s end as retry_after_s from w""",
        "pacing_starts": f"""
with e as (select *, row_number() over (partition by user_id order by ms, event_id) - 1 as i from {_EVENTS}),
s as (select event_id, ms, i * 4000 + max(ms - i * 4000) over (partition by user_id order by i) as start_ms from e)
select event_id, start_ms, start_ms - ms as wait_ms from s""",
        "cache_evict": f"""
with e as (select event_id, user_id, sum(event_id % 1000 + 1) over (partition by user_id order by ms desc, event_id desc rows unbounded preceding) as kept_bytes from {_EVENTS})
select event_id, user_id, kept_bytes::bigint as kept_bytes from e where kept_bytes <= 10000""",
        "ttl_live": f"with e as (select * from {_EVENTS}) select event_id from e where ms >= (select max(ms) from e) - 86400000 or ms is null",
        "recents_top5": f"""
with e as (select user_id, event_id, row_number() over (partition by user_id order by ms desc, event_id desc) as place from {_EVENTS})
select user_id, place, event_id from e where place <= 5""",
        "positions_latest": f"""
with e as (select * from {_EVENTS})
select user_id, arg_max(event_id, (ms, event_id)) as event_id, arg_max(event_type, (ms, event_id)) filter (event_type is not null) as event_type,
  arg_max(value, (ms, event_id)) filter (value is not null) as value from e group by user_id""",
        "inflight_dedup": "select sha256(text) as content_key, min(doc_id) as first_doc, count(*) - 1 as saved from documents where text is not null group by 1",
        "stratified_sample": f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as o from documents),
d as (select text, min(struct_pack(doc_id := doc_id, o := o)) as place from l where text <> '' group by text),
s as (select *, case when {_units("text")} < 120 then 'short' when {_units("text")} <= 260 then 'mid' else 'long' end as stratum from d),
r as (select *, row_number() over (partition by stratum order by place) - 1 as i, count(*) over (partition by stratum) as n, case stratum when 'short' then 12 when 'mid' then 16 else 12 end as quota from s),
q as (select *, least(quota, n) as q from r)
select stratum, place.doc_id as doc_id, place.o as ord, text from q where list_contains(list_transform(range(q), lambda k: (k * n) // q), i)""",
        "mock_duration": f"select doc_id, {_units("coalesce(text, '')")} as n_units, least(3.0, greatest(1.0, {_units("coalesce(text, '')")} * 0.01::double)) as seconds from documents",
        "fingerprints": f"select doc_id, 'doc-' || substring(sha256(text), 1, 32) as document, {_units('text')} || ':' || substring(sha256(text), 1, 12) as logged from documents where text is not null",
        "cache_keys": """
select item_id, sha256('{"t":"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n')
  || '","p":"mock","m":"m","v":"v","s":1,"f":"wav","e":"1.1.0"}') as cache_key from benchmark where text is not null""",
        "es_cardinal": f"select o_orderkey, {_cardinal('o_orderkey')} as words from orders",
        "currency_words": f"""
with c as (select o_orderkey, floor(o_totalprice * 100 + 0.5)::bigint as c from orders),
p as (select o_orderkey, c // 100 as w, c % 100 as d from c)
select o_orderkey, case when w = 0 then {_cardinal('d')} || ' céntimos' else {_cardinal('w')} || ' euros con ' || {_cardinal('d')} || ' céntimos' end as words from p""",
        "date_words": f"select day(l_shipdate) || ' de ' || ({_quoted(_MONTHS)})[month(l_shipdate)] || ' de ' || year(l_shipdate) as words, count(*) as n from lineitem group by 1",
        "ordinal_words": f"select regexp_replace(({_quoted(_FIRST_TO_SEVENTH)})[l_linenumber], 'o$', case when l_returnflag = 'R' then 'a' else 'o' end) as words, count(*) as n from lineitem group by 1",
        "toc_asof": """
with toc as (select conv_id, turn as pos, role || '-' || turn as label from conversations where turn % 3 = 1)
select c.conv_id, c.turn, arg_max(t.label, t.pos) as label from conversations c left join toc t on t.conv_id = c.conv_id and t.pos <= c.turn group by 1, 2""",
        "timeline_prefix": f"with {LISTEN_TIMED} select conv_id, turn, gap, floor(start * 1000 + 0.5) / 1000 as start from placed",
        "active_chunk": f"""
with {LISTEN_TIMED}, p as (select conv_id, turn * 2.5::double as time from conversations)
select p.conv_id, p.time, min(x.turn) as chunk from p left join placed x on x.conv_id = p.conv_id and x.start <= p.time and p.time < x.start + (x.duration + x.gap) group by 1, 2""",
        "timeline_totals": f"with {LISTEN_TIMED} select conv_id, floor(sum(duration + gap) * 1000 + 0.5) / 1000 as seconds, count(*) as chunks from timed group by 1",
        "chapters": """
with h as (select conv_id, turn, floor((turn - 1) / 4)::bigint as start from conversations where role = 'user'),
l as (select *, lag(start) over (partition by conv_id order by start, turn) as b from h)
select conv_id, turn, start from l where b is null or b <> start""",
        "monotonic": """
with s as (select conv_id, length(text) - lag(length(text)) over (partition by conv_id order by turn) as d from conversations)
select conv_id as doc_id, coalesce(min(d), 0) >= 0 as in_order from s group by 1""",
        "table_speech": """
with r as (
  select n_regionkey as doc_id, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as k, n_name from nation)
select doc_id::bigint as doc_id, string_agg('Row ' || k || '. Name: ' || n_name || '. Key: ' || n_nationkey || '. Mark: x', '. ' order by k) as text from r group by 1""",
        "speech_balance": """
with s as (
  select conv_id, coalesce(sum(length(text)) filter (role = 'user'), 0) as u, coalesce(sum(length(text)) filter (role = 'assistant'), 0) as a from conversations group by 1)
select conv_id, case when u > 0 and a > 0 then floor(greatest(u, a) / least(u, a) * 100 + 0.5) / 100 end as ratio from s""",
    }
