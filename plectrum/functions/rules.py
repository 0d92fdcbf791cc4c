"""The ordered verbalisation rules as native projections.

A rule is a pattern and a replacement expression over one hit.  Gaps and hits of the text are
interleaved with the replacements; a hit whose replacement is null or equal stays and is not
recorded.  Rules run one after the other, each on the text the last one left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectrum.functions import spanish as es
from plectrum.functions.text import LEFT, RIGHT, SPACE, WORD_START

S = f"[{SPACE}]"
RULES_A_STEP = 3
RECORD = "array<struct<rule:string,source:string,replacement:string>>"


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    replace: Callable[[Column], Column]
    #: Only texts that match this are touched.
    gate: str | None = None
    #: Whether a hit has a digit; texts without one pass all such rules unread, since no rule writes a digit.
    digits: bool = False
    value_preserving: bool = True
    #: Records come by source in this order, as if each had been a rule of its own.
    in_order: tuple[str, ...] = ()
    #: A hit holds one of these in lower case; none: any text may have a hit.
    needs: tuple[str, ...] = ()


def _group(hit: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(hit, pattern, k)


# Abbreviations in order of application, and acronyms.
ABBREVIATIONS = (
    ("núm.", "número"), ("núms.", "números"), ("apdo.", "apartado"), ("apdos.", "apartados"), ("pág.", "página"),
    ("págs.", "páginas"), ("párr.", "párrafo"), ("disp.", "disposición"), ("EE.UU.", "Estados Unidos"),
    ("EE. UU.", "Estados Unidos"),
)
ACRONYMS = "SOCIMI BORME EIOPA UCITS CNMV CNMC ESMA FROB AEAT SEPI IPSE BOE BCE BEI EBA FMI MEF".split()


_ABBREVIATION = r"(?<![A-Za-z0-9ÁÉÍÓÚÑáéíóúñ])(?:" + "|".join(rf"\Q{short}\E" for short, _ in ABBREVIATIONS) + ")" + RIGHT


_PROVISION = rf"(?iu){WORD_START}D\.{S}*([ATF])\.{S}*"
_ARTICLE = rf"(?iu){WORD_START}(arts?\.|Art(?:[íi]cul[oa]s?)?\.?){S}+(\d+(?:\.\d+){{0,2}})(?:([.)]){S}*)?(?:\({S}*([a-zñ]){S}*\)|([a-zñ])\))?"
_KEYWORD = (
    rf"(?iu){WORD_START}(apartados?|párrafos?|números?|secci[oó]n(?:es)?|reglas?|cifras?|letras?|incisos?){S}+"
    rf"(?:(\d+(?:\.\d+)*)|\({S}*([ivxlcdm]+){S}*\)|([a-zñ])\)?)"
)
_ROMAN = rf"(?iu){WORD_START}(anexos?|títulos?|capítulos?|secci[oó]n(?:es)?|disposiciones?){S}+\(?{S}*([ivxlcdm]+){S}*\)?(\.?)"
_GROUPED = r"\d+(?:\.\d{3})*"
_MONEY = rf"({_GROUPED}(?:,\d{{1,2}})?){S}*(?:€|euros?|EUR)"


def _article(h: Column) -> Column:
    p = f"^{_ARTICLE}$"
    plural = F.regexp_replace(_group(h, p, 1), r"\.$", "").rlike("[sS]$")
    levels = F.split(_group(h, p, 2), r"\.")
    second, third = F.get(levels, F.lit(1)), F.get(levels, F.lit(2))
    word = F.when(plural, F.lit("artículos ")).otherwise(F.lit("artículo "))
    out = F.concat(word, es.integer_words(F.get(levels, F.lit(0))))
    out = F.concat(out, F.when(second.isNull(), F.lit("")).otherwise(F.concat(F.lit(", apartado "), es.integer_words(second))))
    out = F.concat(out, F.when(third.isNull(), F.lit("")).otherwise(F.concat(F.lit(", párrafo "), es.integer_words(third))))
    letter = F.concat(_group(h, p, 4), _group(h, p, 5))
    out = F.concat(out, F.when(letter == "", F.lit("")).otherwise(F.concat(F.lit(", letra "), es.letter_name(letter))))
    stop = F.when(h.rlike(f"{S}$"), F.lit(". ")).otherwise(F.lit("."))
    return F.concat(out, F.when((_group(h, p, 3) == ".") & (letter == ""), stop).otherwise(F.lit("")))


def _keyword(h: Column) -> Column:
    p = f"^{_KEYWORD}$"
    number, roman, letter = (_group(h, p, k) for k in (2, 3, 4))
    word = (
        F.when(number != "", es.decimal_words(number))
        .when(roman != "", es.integer_words(es.roman_value(roman).cast("string")))
        .otherwise(es.letter_name(letter))
    )
    return F.concat(_group(h, p, 1), F.lit(" "), word)


def _roman(h: Column) -> Column:
    p = f"^{_ROMAN}$"
    return F.concat(_group(h, p, 1), F.lit(" "), es.integer_words(es.roman_value(_group(h, p, 2)).cast("string")), _group(h, p, 3), F.lit(" "))


def _date(pattern: str, d: int, m: int, y: int) -> Callable[[Column], Column]:
    return lambda h: es.date_words(_group(h, pattern, d), _group(h, pattern, m), _group(h, pattern, y))


def _money(h: Column) -> Column:
    literal = _group(h, f"^{_MONEY}$", 1)
    whole, cents = es.whole_digits(literal), es.decimals(literal)
    word = es.integer_words(whole)
    unit = F.when(word.rlike("(?:^| )(?:millones|millón|billones|billón)$"), F.lit(" de euros")).otherwise(F.lit(" euros"))
    in_cents = F.concat(es.integer_words(cents), F.lit(" céntimos"))
    with_cents = F.when(whole == "0", in_cents).otherwise(F.concat(word, unit, F.lit(" con "), in_cents))
    return F.when(cents == "", F.concat(word, unit)).otherwise(with_cents)


def _ordinal(h: Column) -> Column:
    p = rf"^(\d+)(\.?){S}?([ºª°])$"
    return F.concat(es.ordinal_word(_group(h, p, 1), _group(h, p, 3) == "ª"), _group(h, p, 2))


def _time(h: Column) -> Column:
    hour, minute = F.split_part(h, F.lit(":"), F.lit(1)), F.split_part(h, F.lit(":"), F.lit(2))
    return F.concat(hour, F.lit(" horas"), F.when(minute == "00", F.lit("")).otherwise(F.concat(F.lit(" y "), minute)))


_RANGE = rf"([0-9]+(?:[.,][0-9]+)?){S}*([–—-]){S}*([0-9]+(?:[.,][0-9]+)?)"


def _range(h: Column) -> Column:
    p = f"^{_RANGE}$"
    a, dash, b = (_group(h, p, k) for k in (1, 2, 3))
    date_like = (dash == "-") & a.rlike(r"^\d{1,2}$") & b.rlike(r"^\d{1,4}$")
    return F.when(~date_like, F.concat(a, F.lit(" a "), b))


def _first(pattern: str) -> Callable[[Column], Column]:
    return lambda h: _group(h, pattern, 1)


_PERCENT, _POINTS = rf"({_GROUPED}(?:,\d+)?){S}*%", rf"(\d+(?:,\d+)?){S}*(?:p\.{S}?b\.|bps|pb)"

# The rules' patterns; their order is part of the meaning.
RULES: tuple[Rule, ...] = (
    Rule("abbreviations", _ABBREVIATION, lambda h: F.try_element_at(es._map(dict(ABBREVIATIONS)), h), in_order=tuple(k for k, _ in ABBREVIATIONS), needs=("núm", "apdo", "pág", "párr.", "disp.", "ee.")),
    Rule("numero-sign", rf"(?iu)nº|núm(?=[.{SPACE}])", lambda h: F.lit("número"), needs=("nº", "núm")),
    Rule("acronyms", rf"(?<![A-Za-z0-9])(?:{'|'.join(ACRONYMS)}|(?<=\()UE(?=\))){RIGHT}", lambda h: F.array_join(F.split(h, ""), " "), needs=(*map(str.lower, ACRONYMS), "(ue)")),
    Rule(
        "provision-abbrev",
        rf"{_PROVISION}(?=\d)",
        lambda h: F.concat(F.try_element_at(es._map({"A": "disposición adicional", "T": "disposición transitoria", "F": "disposición final"}), F.upper(_group(h, f"^{_PROVISION}$", 1))), F.lit(" ")),
        digits=True,
        needs=("d.",),
    ),
    Rule("legal-references", _ARTICLE, _article, digits=True, needs=("art",)),
    Rule("keyword-references", _KEYWORD + RIGHT, _keyword, needs=("apartado", "párrafo", "número", "secci", "regla", "cifra", "letra", "inciso")),
    Rule("roman-headings", _ROMAN + f"(?={S})", _roman, needs=("anexo", "título", "capítulo", "secci", "disposici")),
    Rule("dates", rf"{LEFT}(\d{{1,2}})/(0?[1-9]|1[0-2])/(\d{{4}}){RIGHT}", _date(r"^(\d+)/(\d+)/(\d+)$", 1, 2, 3), digits=True, needs=("/",)),
    Rule("dates-iso", rf"{LEFT}(\d{{4}})-(0[1-9]|1[0-2])-(3[01]|[12]\d|0[1-9])(?![0-9A-Za-z-])", _date(r"^(\d+)-(\d+)-(\d+)$", 3, 2, 1), digits=True, needs=("-",)),
    Rule("dates-hyphen", rf"{LEFT}(\d{{1,2}})-(0?[1-9]|1[0-2])-(\d{{4}})(?![0-9A-Za-z-])", _date(r"^(\d+)-(\d+)-(\d+)$", 1, 2, 3), digits=True, needs=("-",)),
    Rule("currencies", rf"(?<![0-9A-Za-z,.]){_MONEY}{RIGHT}", _money, digits=True, needs=("€", "euro", "eur")),
    Rule("percentages", LEFT + _PERCENT + RIGHT, lambda h: F.concat(es.decimal_words(_group(h, _PERCENT, 1)), F.lit(" por ciento")), digits=True, needs=("%",)),
    Rule("basis-points", f"(?iu){LEFT}{_POINTS}{RIGHT}", lambda h: F.concat(es.decimal_words(_group(h, f"(?iu){_POINTS}", 1)), F.lit(" puntos básicos")), digits=True, needs=("p.", "bps", "pb")),
    Rule(
        "settlement",
        rf"{WORD_START}([TD])\+(\d{{1,2}})(?![A-Za-z0-9_])",
        lambda h: F.concat(F.substring(h, 1, 1), F.lit(" más "), es.integer_words(F.substring(h, 3, 2))),
        digits=True,
        needs=("t+", "d+"),
    ),
    Rule("ordinals", rf"(\d+)(\.?){S}?([ºª°]){RIGHT}", _ordinal, digits=True, needs=("º", "ª", "°")),
    Rule("time", r"(?<![\d:])(\d{1,2}):([0-5]\d)(?![\d:])", _time, digits=True, needs=(":",)),
    Rule("slash-citations", rf"{LEFT}([0-9]{{1,4}})/([0-9]{{1,4}}){RIGHT}", lambda h: F.replace(h, F.lit("/"), F.lit(", ")), digits=True, needs=("/",)),
    Rule("ranges", LEFT + _RANGE + RIGHT, _range, digits=True, needs=("–", "—", "-")),
    Rule("lei", rf"(?iu){LEFT}[A-Z0-9]{{20}}{RIGHT}", es.spelled, gate=rf"(?i){WORD_START}LEI(?![A-Za-z0-9_])", needs=("lei",)),
    Rule("isin", rf"(?iu){LEFT}[A-Z]{{2}}[A-Z0-9]{{10}}{RIGHT}", es.spelled, gate=rf"(?i){WORD_START}ISIN(?![A-Za-z0-9_])", needs=("isin",)),
    Rule("numbers", rf"(?<![0-9A-Za-z.])[0-9]+(?:\.[0-9]{{3}})*(?:,[0-9]+)?{RIGHT}(?!\.[0-9])", es.decimal_words, digits=True),
)
RULE_IDS = tuple(dict.fromkeys(r.id for r in RULES))


def _changed(rule: Rule) -> Callable[[Column], Column]:
    return lambda hit: F.coalesce(rule.replace(hit), hit)


#: Characters whose lower case is not what a pattern without regard to case takes them for.
_ODD_CASE = ("ſ", "ı", "\u212a", "İ")


def _may_fire(rules: tuple[Rule, ...]) -> str:
    """SQL lambda: for each rule whether a text (t) can have a hit at all, by its digits and by substrings of its lower case, found without patterns."""
    needs = ", ".join(f"array({', '.join(map(_sql, rule.needs or ('',)))})" for rule in rules)  # an empty one stands in every text
    digits = ", ".join("true" if rule.digits else "false" for rule in rules)
    odd = " OR ".join(f"contains(t, {_sql(c)})" for c in _ODD_CASE)
    each = f"transform(array({needs}), (own, i) -> (x.digits OR NOT get(array({digits}), i)) AND (x.odd OR exists(own, n -> contains(x.low, n))))"
    return f"t -> get(transform(array(named_struct('low', lower(t), 'odd', {odd}, 'digits', t RLIKE '[0-9]')), x -> {each}), 0)"


def _start(text: Column, rules: tuple[Rule, ...]) -> Column:
    own = F.coalesce(text, F.lit(""))
    return F.struct(own.alias("spoken"), F.array().cast(RECORD).alias("records"), es.sql_let(own, _may_fire(rules)).alias("may"), F.lit(0).alias("seen"))


def _sql(text: str) -> str:
    """A raw string literal."""
    if "'" in text:
        raise ValueError(f"a quote in {text!r}")
    return f"r'{text}'"


def _look(rule: Rule, place: int) -> str:
    """SQL lambda: a state beside the rule's hits in it.

    ``may`` tells of the text that had ``seen`` records; once a rule has changed it, every rule looks until the state is told anew,
    since what a rule writes may be a hit of any later one.
    """
    tests = [f"(size(b.records) > b.seen OR get(b.may, {place}))"]
    if rule.gate:
        tests.append(f"b.spoken RLIKE {_sql(rule.gate)}")
    return f"b -> named_struct('b', b, 'f', CASE WHEN {' AND '.join(tests)} THEN regexp_extract_all(b.spoken, {_sql(rule.pattern)}, 0) END)"


def _rewrite(rule: Rule) -> str:
    """SQL lambda: the state after the rule, from the one before (b), the hits (f) and their replacements (n)."""
    spoken = f"array_join(zip_with(split(z.b.spoken, {_sql(rule.pattern)}, -1), z.n, (g, n) -> concat(g, coalesce(n, ''))), '')"
    told = f"filter(zip_with(z.f, z.n, (h, n) -> named_struct('rule', {_sql(rule.id)}, 'source', h, 'replacement', n)), t -> t.source <> t.replacement)"
    if rule.in_order:
        told = f"get(transform(array({told}), w -> concat({', '.join(f'filter(w, x -> x.source = {_sql(source)})' for source in rule.in_order)})), 0)"
    return f"z -> CASE WHEN size(z.f) > 0 THEN named_struct('spoken', {spoken}, 'records', concat(z.b.records, {told}), 'may', z.b.may, 'seen', z.b.seen) ELSE z.b END"


def _step(rule: Rule, place: int, state: Column) -> Column:
    """The state (spoken, records, may, seen) after one rule, the place-th of its chain."""

    def with_new(y: Column) -> Column:
        new = F.when(F.size(y["f"]) > 0, F.transform(y["f"], _changed(rule)))
        return F.struct(y["b"].alias("b"), y["f"].alias("f"), new.alias("n"))

    return es.sql_let(es.let(es.sql_let(state, _look(rule, place)), with_new), _rewrite(rule))


def _told_anew(rules: tuple[Rule, ...]) -> str:
    """SQL lambda: a state whose text has changed with what can fire on the text as it now is."""
    may = f"get(transform(array(b.spoken), {_may_fire(rules)}), 0)"
    return f"b -> CASE WHEN size(b.records) > b.seen THEN named_struct('spoken', b.spoken, 'records', b.records, 'may', {may}, 'seen', size(b.records)) ELSE b END"


def fenced(df: DataFrame) -> DataFrame:
    """df behind a one-row generator: predicates on its columns are not inlined into what computes them."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


#: Chains by gateway and rules: building one takes seconds of calls to the JVM, and it is the same for every table.
_CHAINS: dict[tuple[int, tuple[Rule, ...]], list[Column]] = {}


def _chain(rules: tuple[Rule, ...]) -> list[Column]:
    """The rules as expressions over ``_state``, a few in each."""
    key = (id(SparkContext._gateway), rules)
    if key not in _CHAINS:
        made = []
        anew = _told_anew(rules)
        for at in range(0, len(rules), RULES_A_STEP):
            own, state = rules[at : at + RULES_A_STEP], F.col("_state")
            for place, rule in enumerate(own, at):
                state = _step(rule, place, state)
            fires = " OR ".join(f"get(_state.may, {place})" for place in range(at, at + len(own)))
            # a state that no rule here can touch is passed on as it is: bound values are copied at every binding
            made.append(F.when(F.expr(fires), es.sql_let(state, anew)).otherwise(F.col("_state")))
        _CHAINS[key] = made
    return _CHAINS[key]


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with ``spoken`` (the rewritten text) and ``records`` (rule, source, replacement in order).

    Values are bound, not repeated, so the plan grows linearly with the rules.  One look at the lower-cased text, taken again when a
    step has changed it, tells which rules can fire on it, and a text passes all other steps unread.  A few rules share each projection: one projection a rule takes
    long to analyse, one for all nests too deep.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*keep, _start(F.col(text), rules).alias("_state"))
    for state in _chain(rules):
        step = step.select(*keep, state.alias("_state"))
    return fenced(step.select(*keep, F.col("_state.spoken").alias("spoken"), F.col("_state.records").alias("records")))


#: Stands for a hit while a text is cut at its hits; texts that hold it themselves are cut by the pattern.
_CUT = "\ue000"


def rewritten(rule_id: str, text: Column) -> Column:
    """The text after one rule alone: no records and no look at what other rules need, so that a hit costs its pattern and its words."""
    rule = next(r for r in RULES if r.id == rule_id)
    pattern = _sql(rule.pattern)
    hits = f"regexp_extract_all(t, {pattern}, 0)"
    found = f"t -> named_struct('t', t, 'f', {f'CASE WHEN t RLIKE {_sql(rule.gate)} THEN {hits} END' if rule.gate else hits})"
    # split() compiles a pattern for every text, a single character it finds without one
    gaps = f"CASE WHEN contains(z.t, '{_CUT}') THEN split(z.t, {pattern}, -1) ELSE split(regexp_replace(z.t, {pattern}, '{_CUT}'), '{_CUT}', -1) END"
    joined = f"z -> CASE WHEN size(z.n) > 0 THEN array_join(zip_with({gaps}, z.n, (g, n) -> concat(g, coalesce(n, ''))), '') ELSE z.t END"

    def with_new(y: Column) -> Column:
        return F.struct(y["t"].alias("t"), F.transform(y["f"], _changed(rule)).alias("n"))

    return es.sql_let(es.let(es.sql_let(F.coalesce(text, F.lit("")), found), with_new), joined)
