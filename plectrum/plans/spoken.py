"""Queries on the rules, the fidelity check, plans and chunks over made-up texts whose results SQL can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectrum.functions.fidelity import critical_tokens, fidelity
from plectrum.functions import rules
from plectrum.functions.rules import rewritten
from plectrum.operators import chunks, evaluation, metrics, plan
from plectrum.plans import oracle
from plectrum.plans.shared import Registered, spread, table

REGISTERED = Registered()
query = REGISTERED.query

# The first Roman numerals, and names of letters and digits for the twins.
_ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
_DIGIT_NAMES = "cero uno dos tres cuatro cinco seis siete ocho nueve".split()


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _spelled(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: case c when 'B' then 'be' when 'E' then 'e' when 'S' then 'ese' else ({oracle._quoted(_DIGIT_NAMES)})[c::int + 1] end), ' ')"


def _rule_twins() -> str:
    word, grouped = oracle._cardinal, "case when k < 1000 then k::varchar else (k // 1000) || '.' || lpad((k % 1000)::varchar, 3, '0') end"
    months = f"({oracle._quoted(oracle._MONTHS)})[k % 12 + 1]"
    date = f"(k % 28 + 1) || ' de ' || {months} || ' de ' || (1990 + k % 40)"
    ordinal = f"({oracle._quoted(oracle._FIRST_TO_SEVENTH)})[k % 7 + 1]"
    columns = {
        "abbreviations": "'Ver página ' || k || ' y número ' || k",
        "numero_sign": "'número ' || k",
        "acronyms": "'La C N M V y (U E) ' || k",
        "provision_abbrev": "case k % 3 when 0 then 'disposición adicional ' when 1 then 'disposición transitoria ' else 'disposición final ' end || k",
        "legal_references": f"'artículo ' || {word('(k % 300 + 1)')} || ', apartado ' || {word('(k % 20 + 1)')} || ' x'",
        "keyword_references": f"'apartado ' || {word('(k % 900)')} || ' x'",
        "roman_headings": f"'título ' || {word('(k % 20 + 1)')} || '  fin'",
        "dates": date,
        "dates_iso": date,
        "dates_hyphen": date,
        "currencies": f"{word('(k % 998 + 2)')} || ' euros'",
        "percentages": f"{word('(k % 100)')} || ' coma ' || ({oracle._quoted(_DIGIT_NAMES)})[k % 10 + 1] || ' por ciento'",
        "basis_points": f"{word('(k % 500)')} || ' puntos básicos'",
        "settlement": f"'T más ' || {word('(k % 31)')}",
        "ordinals": f"{ordinal} || ' y ' || regexp_replace({ordinal}, 'o$', 'a')",
        "time": "(k % 24) || ' horas' || case when k % 60 = 0 then '' else ' y ' || lpad((k % 60)::varchar, 2, '0') end",
        "slash_citations": "(k % 1000) || ', ' || (k % 77)",
        "ranges": "(k % 1000) || ' a ' || (k % 77)",
        "lei": f"'LEI ' || {_spelled('lpad(k::varchar, 20, chr(66))')}",
        "isin": f"'ISIN ' || {_spelled(chr(39) + 'ES' + chr(39) + ' || lpad(k::varchar, 10, chr(48))')}",
        "numbers": word("k"),
        "grouped": grouped,
    }
    return f"select k as o_orderkey, {', '.join(f'{v} as {n}' for n, v in columns.items())} from (select o_orderkey as k from orders)"


#: Rules whose made-up texts are about a thousand at most, however many orders there are.
_FEW_TEXTS = ("legal-references", "keyword-references", "roman-headings", "dates", "dates-iso", "dates-hyphen", "currencies", "percentages", "basis-points", "settlement", "ordinals", "time")


def _rewritten_once(df: DataFrame, source: DataFrame, rule: str, text: Column) -> DataFrame:
    """df with the rule's output under its name: each distinct text of source, which has all of df's, is rewritten once and sent to every task."""
    own, out = f"_{rule}", rule.replace("-", "_")
    texts = source.select(F.coalesce(text, F.lit("")).alias(own)).distinct()
    told = texts.select(own, rewritten(rule, F.col(f"`{own}`")).alias(out))
    return df.withColumn(own, F.coalesce(text, F.lit(""))).join(F.broadcast(told), own).drop(own)


@query(_rule_twins())
def rule_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the 21 rules alone on a text made from an order's number."""
    k = F.col("o_orderkey")
    roman = F.element_at(F.array(*map(F.lit, _ROMANS)), (k % 20 + 1).cast("int"))
    day, month, year = k % 28 + 1, k % 12 + 1, 1990 + k % 40
    grouped = F.when(k < 1000, k.cast("string")).otherwise(_text(F.floor(k / 1000), ".", F.lpad((k % 1000).cast("string"), 3, "0")))
    letter = F.when(k % 3 == 0, "A").when(k % 3 == 1, "T").otherwise("F")
    texts = {
        "abbreviations": _text("Ver pág. ", k, " y núm. ", k), "numero-sign": _text("nº ", k), "acronyms": _text("La CNMV y (UE) ", k), "provision-abbrev": _text("D. ", letter, ". ", k),
        "legal-references": _text("art. ", k % 300 + 1, ".", k % 20 + 1, " x"), "keyword-references": _text("apartado ", k % 900, " x"), "roman-headings": _text("título ", roman, " fin"),
        "dates": _text(day, "/", month, "/", year), "dates-iso": _text(year, "-", _two(month), "-", _two(day)), "dates-hyphen": _text(day, "-", month, "-", year), "currencies": _text(k % 998 + 2, " €"),
        "percentages": _text(k % 100, ",", k % 10, " %"), "basis-points": _text(k % 500, " pb"), "settlement": _text("T+", k % 31), "ordinals": _text(k % 7 + 1, "º y ", k % 7 + 1, "ª"),
        "time": _text(k % 24, ":", _two(k % 60)), "slash-citations": _text(k % 1000, "/", k % 77), "ranges": _text(k % 1000, "–", k % 77), "lei": _text("LEI ", F.lpad(k.cast("string"), 20, "B")),
        "isin": _text("ISIN ES", F.lpad(k.cast("string"), 10, "0")), "numbers": grouped,
    }
    source = _orders(spark, sf_dir).select("o_orderkey")
    rows = spread(source, "o_orderkey")
    for rule in _FEW_TEXTS:
        rows = _rewritten_once(rows, source, rule, texts[rule])
    outputs = [F.col(r.replace("-", "_")) if r in _FEW_TEXTS else rewritten(r, t).alias(r.replace("-", "_")) for r, t in texts.items()]
    return rows.select("o_orderkey", *outputs, grouped.alias("grouped"))


@query(
    """
with k as (select o_orderkey as k, o_orderkey % 5 as v from orders)
select k as o_orderkey, v in (0, 3) as ok, case v when 1 then 'salvo que' when 4 then (k + 10)::varchar else '' end as lost, case v when 2 then '999999' else '' end as invented,
  'legal-term:deberá,number:' || (k + 10) || ',legal-term:salvo que,number:5,ordinal:5º,isin:ESABCDEFGHIJ' as tokens from k"""
)
def fidelity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five renderings of an order's sentence: as it is, a term lost, a number invented, a number in covered words, a number in words without a record."""
    k = F.col("o_orderkey") + 10
    source = _text("deberá pagar ", k, " euros, salvo que venza en 5º de ESABCDEFGHIJ")
    v = F.col("o_orderkey") % 5
    words = F.replace(source, k.cast("string"), F.lit("muchos"))
    spoken = F.when(v == 1, F.replace(source, F.lit("salvo que "), F.lit(""))).when(v == 2, _text(source, " 999999")).when(v > 2, words).otherwise(source)
    record = F.array(F.struct(F.lit("currencies").alias("rule"), k.cast("string").alias("source"), F.lit("muchos").alias("replacement")))
    records = F.when(v == 3, record).otherwise(F.array().cast(plan.TRANSFORMATIONS))
    rows = spread(_orders(spark, sf_dir), "o_orderkey").select("o_orderkey", fidelity(source, spoken, records).alias("f"), critical_tokens(source).alias("t"))
    said = lambda c: F.array_join(F.transform(c, lambda t: t["text"]), ",")
    tokens = F.array_join(F.transform("t", lambda t: F.concat(t["kind"], F.lit(":"), t["text"])), ",")
    return rows.select("o_orderkey", "f.ok", said(F.col("f.lost")).alias("lost"), said(F.col("f.invented")).alias("invented"), tokens.alias("tokens"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a document: headings, sums, footers and plain sentences in turn."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "heading").when(k % 4 == 2, "page-footer").otherwise("paragraph")
    said = F.when(k % 4 == 0, _text("Nota ", k, ".")).when(k % 4 == 1, _text("Pago de ", k + 2, " euros")).when(k % 4 == 2, _text("Pie ", k)).otherwise("sin cambios")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return spread(_orders(spark, sf_dir), "o_custkey").select(F.col("o_custkey").alias("doc_id"), at.alias("ord"), kind.alias("type"), said.alias("text"), F.lit(1).alias("page"))


_MADE = f"""
b as (select o_custkey as doc_id, o_orderkey as k, o_orderkey % 4 as v, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord from orders),
p as (select doc_id, ord, v, 's' || ord as segment_id, case v when 0 then 'Nota ' || {oracle._cardinal("k")} || ',' when 1 then 'Pago de ' || {oracle._cardinal("(k + 2)")} || ' euros' when 2 then '' else 'sin cambios' end as spoken_text,
  case v when 0 then 'numbers,pause' when 1 then 'currencies' when 2 then 'layout-noise' else '' end as rules, v = 2 as muted, case when v = 2 then 'layout-classification' end as muted_by from b)"""


@query(f"with {_MADE} select doc_id, segment_id, spoken_text, rules, true as fidelity_ok, muted, muted_by from p")
def listen_plan_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listen plan of the made-up documents."""
    out = plan.listen_plan(_blocks(spark, sf_dir))
    return out.select("doc_id", "segment_id", "spoken_text", F.array_join(F.transform("transformations", lambda t: t["rule"]), ",").alias("rules"), "fidelity_ok", "muted", "muted_by")


@query(
    f"""with {_MADE} select doc_id, count(*) as blocks_total, count(case when v <> 2 then 1 end) as segments, count(case when v = 2 then 1 end) as muted_noise, count(case when v < 2 then 1 end) as transformed,
  count(case when v = 3 then 1 end) as unchanged, 0::bigint as rejected, count(case when v = 0 then 1 end)::int as numbers, count(case when v = 0 then 1 end)::int as pauses, count(case when v = 1 then 1 end)::int as currencies from p group by 1"""
)
def plan_stats_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and the histogram of rules of the made-up documents."""
    out = plan.plan_stats(plan.listen_plan(_blocks(spark, sf_dir)))
    hits = lambda r: F.coalesce(F.try_element_at("rule_hits", F.lit(r)), F.lit(0))
    return out.select("doc_id", "blocks_total", "segments", "muted_noise", "transformed", "unchanged", "rejected", hits("numbers").alias("numbers"), hits("pause").alias("pauses"), hits("currencies").alias("currencies"))


_PACKED = """
with recursive t as (select conv_id as doc_id, row_number() over (partition by conv_id order by turn) as i, turn, regexp_replace(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)), '[^ -~]', 'x', 'g') as piece from conversations),
h as (select *, row_number() over (partition by doc_id order by i) as r from t where piece <> ''),
c as (
  select doc_id, r, 0 as chunk, length(piece) as n from h where r = 1 union all
  select h.doc_id, h.r, case when c.n + length(piece) + 1 > 400 then c.chunk + 1 else c.chunk end, case when c.n + length(piece) + 1 > 400 then length(piece) else c.n + 1 + length(piece) end from c join h on h.doc_id = c.doc_id and h.r = c.r + 1)"""


def _turn_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    piece = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+\z", ""), "[^ -~]", "x")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.lit(0).alias("part"), _text("s", F.col("turn")).alias("segment_id"), piece.alias("piece")).where("piece <> ''")


@query(_PACKED + "\nselect doc_id, chunk, string_agg(piece, ' ' order by r) as text, string_agg('s' || turn, ',' order by r) as segments from c join h using (doc_id, r) group by 1, 2")
def chunk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns, whole, packed into chunks of 400 units; a longer turn is a chunk of its own."""
    return chunks.pack(_turn_pieces(spark, sf_dir), 400).select("doc_id", "chunk", "text", F.array_join("segment_ids", ",").alias("segments"))


@query(
    _PACKED.replace("length(piece)", "length(piece) + 150")
    + """,
k as (select doc_id, chunk, rtrim(string_agg(piece || repeat(' ', 150), ' ' order by r)) as text, string_agg('s' || turn, ',' order by r) as segments from c join h using (doc_id, r) group by 1, 2),
m as (
  select doc_id, chunk, 0 as merged, length(text) as n from k where chunk = 0 union all
  select k.doc_id, k.chunk, case when j then m.merged else m.merged + 1 end, case when j then m.n + 1 + length(k.text) else length(k.text) end
  from m join k on k.doc_id = m.doc_id and k.chunk = m.chunk + 1, lateral (select (m.n < 200 or length(k.text) < 200) and m.n + 1 + length(k.text) <= 400 as j))
select doc_id, merged as chunk, string_agg(text, ' ' order by chunk) as text, string_agg(segments, ',' order by chunk) as segments from m join k using (doc_id, chunk) group by 1, 2"""
)
def chunk_turns_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with wide ends that fall away in a chunk: a chunk of under 200 units then joins the one before it where both fit."""
    parts = _turn_pieces(spark, sf_dir).withColumn("piece", F.concat("piece", F.repeat(F.lit(" "), 150)))
    return chunks.pack(parts, 400, 200).select("doc_id", "chunk", "text", F.array_join("segment_ids", ",").alias("segments"))


@query(
    f"""
with k as (select conv_id as doc_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, role from conversations)
select doc_id, 's' || i as segment_id, case when role = 'user' then 'Véase [' || {oracle._cardinal("(turn % 3 + 1)")} || '].' || case when turn % 3 = 2 then '' else ' Nota ' || {oracle._cardinal("(turn % 3 + 1)")} || ': ' || {oracle._cardinal("(turn % 3 + 1)")} || ' b' end
  else 'sin nota' end as spoken_text from k"""
)
def notes_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to three notes, of which the first two are there, the last of equals wins; notes themselves are not spoken."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), "role")
    said = F.when(F.col("role") == "user", _text("Véase [", F.col("ord") % 3 + 1, "].")).otherwise("sin nota")
    blocks = turns.select("doc_id", "ord", F.lit("paragraph").alias("type"), said.alias("text"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("level"))
    notes = turns.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, ("1 a", "2 b", "1 b")))).alias("n", "text"))
    notes = notes.select("doc_id", (F.col("n") + 1000).alias("ord"), F.lit("footnote").alias("type"), "text", F.lit(1).alias("page"), F.lit(None).cast("int").alias("level"))
    return plan.product_plan(blocks.unionByName(notes)).select("doc_id", "segment_id", "spoken_text")


# --- reports over the made-up documents -------------------------------------------------------------


@query(
    f"""with {_MADE} select doc_id, count(*) as segments, count(case when v = 2 then 1 end) as muted, 0::bigint as fallbacks, count(case when v = 0 then 1 end)::int as numbers, count(case when v = 1 then 1 end)::int as monetary, 0::bigint as violations, true as pass
from p group by 1"""
)
def fidelity_report_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The independent check of the made-up documents' plans."""
    out = evaluation.fidelity_report(plan.listen_plan(_blocks(spark, sf_dir)))
    kept = lambda c: F.coalesce(F.try_element_at("preserved", F.lit(c)), F.lit(0))
    return out.select("doc_id", "segments", "muted", "fallbacks", kept("numbers").alias("numbers"), kept("monetary").alias("monetary"), "violations", "pass")


@query(
    f"""
with {_MADE}, r as (select p.doc_id, p.segment_id, p.v, b.k, p.spoken_text, p.rules from p join b using (doc_id, ord) where p.v < 2)
select 'corpus:' || doc_id || ':' || segment_id as id, 'corpus' as origin, rules as construction_classes, case v when 0 then 'Nota ' || k || '.' else 'Pago de ' || (k + 2) || ' euros' end as source_text, spoken_text,
  case v when 0 then 'numbers[' || k || ' -> ' || {oracle._cardinal("k")} || '] | pause[ -> , ]' else 'currencies[' || (k + 2) || ' euros -> ' || {oracle._cardinal("(k + 2)")} || ' euros]' end as transformations from r"""
)
def review_packet_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.review_packet(plan.listen_plan(_blocks(spark, sf_dir)))


@query(f"with {_MADE}, r as (select unnest(string_split(rules, ',')) as class from p where v < 2) select class, count(*) as n from r group by 1")
def construction_classes_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_histogram(evaluation.review_packet(plan.listen_plan(_blocks(spark, sf_dir))))


@query(f"with {_MADE}, r as (select doc_id, unnest(string_split(rules, ',')) as rule from p where rules <> '') select doc_id, count(distinct rule) as fired, floor(count(distinct rule) / 21 * 1000 + 0.5) / 1000 as share from r group by 1")
def rule_coverage_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the rules have fired in each made-up document, muting included."""
    return metrics.rule_coverage(plan.listen_plan(_blocks(spark, sf_dir)), 21)


@query(
    """
with g as (select o_custkey as doc_id, o_orderkey % 3 as v from orders)
select doc_id, count(*) as entries, floor(avg(case v when 0 then 1.0 when 1 then 0.857 else 0.667 end::double) * 1000 + 0.5) / 1000 as mean_dice, count(case when v = 0 then 1 end) as exact from g group by 1"""
)
def gold_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken texts that equal the manual one up to case and blanks, lack a word of four, or half of them."""
    k = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), k.alias("block_id"), F.lit("uno dos tres cuatro").alias("gold_text"), F.when(k % 3 == 0, "Uno  dos TRES cuatro").when(k % 3 == 1, "uno dos tres").otherwise("uno dos").alias("spoken_text"))
    return metrics.gold_agreement(rows.select("doc_id", "block_id", "gold_text"), rows.select("doc_id", "block_id", "spoken_text"))


@query("select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ref, row_number() over (partition by o_custkey order by o_orderkey) - 1 as got, 0.9::double as dice from orders")
def greedy_match_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference block likes its predecessor's match better than its own, but that one is taken; below the threshold nothing matches."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1
    refs = _orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), at.alias("ref"))
    liked = F.array(F.struct((F.col("ref") - 1).alias("got"), F.lit(0.95).alias("dice")), F.struct(F.col("ref").alias("got"), F.lit(0.9).alias("dice")), F.struct((F.col("ref") + 1).alias("got"), F.lit(0.54).alias("dice")))
    return metrics.greedy_match(refs.select("doc_id", "ref", F.inline(liked)).where("got >= 0"))


@query(
    """
with b as (select o_custkey as doc_id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord from orders),
t as (select *, ord // 2 as page, case k % 6 when 0 then 'page-number' when 1 then 'paragraph' when 2 then 'page-header' when 3 then 'page-footer' when 4 then 'page-header' else 'paragraph' end as type from b),
p as (select *, (select count(distinct page) from t u where u.doc_id = t.doc_id and u.k % 6 = 2) as pages from t)
select doc_id, ord, k % 6 in (0, 1) or (k % 6 = 2 and pages >= 3) as omit from p"""
)
def safe_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers, rules of dashes and known headings on three pages may go; terms, unknown texts and sentences may not."""
    k = F.col("o_orderkey") % 6
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    kind = F.when(k == 0, "page-number").when(k.isin(2, 4), "page-header").when(k == 3, "page-footer").otherwise("paragraph")
    said = F.when(k == 0, "pág. 7 de 9").when(k == 1, "— * —").when(k == 2, " Documento  Oficial").when(k == 3, "salvo que").when(k == 4, _text("Cabecera ", F.col("o_orderkey"))).otherwise("documento oficial")
    blocks = _orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), at.cast("long").alias("ord"), kind.alias("type"), said.alias("text"), F.floor(at / 2).alias("page"))
    return plan.omission_is_safe(blocks).select("doc_id", "ord", "omit")


@query(
    """
with o as (select o_orderkey as k, o_orderkey % 150 + 1 as m from orders), c as (select k, m, unnest(range(0, (m + 39) // 40)) as chunk from o),
w as (select k, chunk, least(40, m - chunk * 40) as n from c)
select k as doc_id, chunk::int as chunk, rtrim(repeat('xxxxxxxxx ', n::int)) as text from w"""
)
def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of up to 150 words without a mark, cut at the last blank within 400 units."""
    k = F.col("o_orderkey")
    said = F.rtrim(F.repeat(F.lit("xxxxxxxxx "), (k % 150 + 1).cast("int")))
    segments = _orders(spark, sf_dir).select(k.alias("doc_id"), F.lit(0).alias("ord"), F.lit("s0").alias("segment_id"), said.alias("spoken_text"), F.lit(False).alias("muted"))
    return chunks.plan_chunks(segments, 400).select("doc_id", "chunk", "text")


#: What a text must hold for any rule to fire on it, for both engines: of its lower case, and as it is.
_TOUCHED = (
    r"[0-9]|núm|nº|apdo|pág|párr\.|disp\.|ee\.|\(ue\)|apartado|párrafo|número|secci|regla|cifra|letra|inciso|anexo|título|capítulo|disposici|(^|[^a-z0-9_])(lei|isin)([^a-z0-9_]|$)",
    "|".join(rules.ACRONYMS),
)
_UNTOUCHED_SQL = f"not regexp_matches(lower({{0}}), '{_TOUCHED[0]}') and not regexp_matches({{0}}, '{_TOUCHED[1]}')"


def _untouched(text: Column) -> Column:
    return ~F.lower(text).rlike(_TOUCHED[0]) & ~text.rlike(_TOUCHED[1])


@query(
    f"""
with {oracle.BLOCKS} select doc_id, 's' || ord as segment_id, text as spoken_text, 0 as n_transformations, true as fidelity_ok, false as fallback, false as muted from numbered where {_UNTOUCHED_SQL.format("text")}"""
)
def listen_plan_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the listen plan of all documents the segments that hold nothing a rule could take up: they are read as they stand."""
    from plectrum.plans.registry import segments

    out = segments(spark, sf_dir, only=_untouched(F.col("text")))
    return out.select("doc_id", "segment_id", "spoken_text", F.size("transformations").cast("long").alias("n_transformations"), "fidelity_ok", "fallback", "muted")


def _cut_after(mark: str) -> str:
    """SQL: where a window ``w`` is cut by the last of its marks that white space and more follow; null without one."""
    hit = f"'{mark}{oracle.WS}+{oracle.WS.replace('[', '[^', 1)}'"
    tail = f"length(list_extract(regexp_split_to_array(w, {hit}), -1)) + length(list_extract(regexp_extract_all(w, {hit}), -1))"
    return f"case when regexp_matches(w, {hit}) then length(w) - ({tail}) + 2 end"


@query(
    f"""
with recursive {oracle.BLOCKS},
plain as (select doc_id from numbered group by 1 having bool_and({_UNTOUCHED_SQL.format("text")})),
cut as (
  select doc_id, ord, 0 as part, null::varchar as piece, text as rest from numbered semi join plain using (doc_id) union all
  select doc_id, ord, part + 1, {oracle.trim("substr(rest, 1, cut_at::int)")}, regexp_replace(substr(rest, cut_at::int + 1), '^{oracle.WS}+', '')
  from (select *, coalesce({_cut_after("[.!?…]")}, {_cut_after(",")}, nullif(length(regexp_extract(w, '(?s)^(.* )', 1)), 0), 400) as cut_at
    from (select *, substr(rest, 1, 400) as w from cut where length(rest) > 400))),
parts as (select doc_id, ord, part, piece from cut where piece <> '' union all select doc_id, ord, part + 1, rest from cut where length(rest) <= 400 and rest <> ''),
h as (select *, row_number() over (partition by doc_id order by ord, part) as r from parts),
c as (
  select doc_id, r, 0 as chunk, length(piece) as n from h where r = 1 union all
  select h.doc_id, h.r, case when c.n + length(piece) + 1 > 400 then c.chunk + 1 else c.chunk end, case when c.n + length(piece) + 1 > 400 then length(piece) else c.n + 1 + length(piece) end from c join h on h.doc_id = c.doc_id and h.r = c.r + 1)
select doc_id, chunk, string_agg(piece, ' ' order by r) as text from c join h using (doc_id, r) group by 1, 2"""
)
def chunk_pack_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the chunks of all documents those of documents that no rule could take up: whole texts, split and packed."""
    from plectrum.plans.registry import segments

    plan_ = segments(spark, sf_dir)
    plain = plan_.groupBy("doc_id").agg(F.every(_untouched(F.col("source_text"))).alias("_plain")).where("_plain").select("doc_id")
    return chunks.plan_chunks(plan_, 400, 200).join(plain, "doc_id", "left_semi").select("doc_id", "chunk", "text")
