"""Spanish number words, letter names and Roman numerals as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the language, in order.
DIGITS = "cero uno dos tres cuatro cinco seis siete ocho nueve".split()
TEENS = "diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve".split()
TWENTIES = "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
#: Hundreds that take "y" before a lone one.
LINKED_HUNDREDS = (5, 7, 9)
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
LETTERS = {
    "a": "a", "b": "be", "c": "ce", "d": "de", "e": "e", "f": "efe", "g": "ge", "h": "hache", "i": "i",
    "j": "jota", "k": "k", "l": "ele", "m": "eme", "n": "ene", "ñ": "eñe", "o": "o", "p": "pe", "q": "cu",
    "r": "ere", "s": "ese", "t": "te", "u": "u", "v": "uve", "w": "uve doble", "x": "equis", "y": "i griega",
    "z": "zeta",
}
ORDINALS_MASCULINE = (
    "primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo undécimo duodécimo decimotercero "
    "decimocuarto decimoquinto decimosexto decimoséptimo decimoctavo decimonoveno vigésimo"
).split()
ORDINALS_FEMININE = "primera segunda tercera cuarta quinta sexta séptima octava novena décima undécima duodécima".split()


def below_thousand() -> list[str]:
    """The words of 0 to 999, by rule."""
    two = DIGITS + TEENS + TWENTIES
    two += [t if not u else f"{t} y {DIGITS[u]}" for t in TENS for u in range(10)]
    out = list(two)
    for h, name in enumerate(HUNDREDS, 1):
        out.append("cien" if h == 1 else name)
        out += [f"{name} y uno" if r == 1 and h in LINKED_HUNDREDS else f"{name} {two[r]}" for r in range(1, 100)]
    return out


def _list(words: list[str]) -> Column:
    """A constant array, folded by the optimizer."""
    return F.split(F.lit("|".join(words)), r"\|")


def _map(pairs: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in pairs.items())), F.lit(r"\|"), F.lit("="))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated and written down once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_let(value: Column, *bodies: str) -> Column:
    """The bodies, SQL lambdas, one after the other on value: a call or two to the JVM each, however long they are."""
    out = F.array(value)
    for body in bodies:
        out = F.call_function("transform", out, F.expr(body))
    return F.get(out, F.lit(0))


def _group_words() -> str:
    """SQL lambda: the words of a struct of five groups of three digits, highest first, and of the words below a thousand."""
    g = [f"get(x.g, {k})" for k in range(5)]
    word = [f"get(x.small, {k})" for k in g]

    def thousands(k: int) -> str:
        return f"CASE WHEN {g[k]} = 1 THEN 'mil' WHEN {g[k]} > 1 THEN concat({word[k]}, ' mil') END, CASE WHEN {g[k + 1]} > 0 THEN {word[k + 1]} END"

    billions = f"CASE WHEN {g[0]} = 1 THEN 'un billón' WHEN {g[0]} > 1 THEN concat({word[0]}, ' billones') END"
    millions = f"CASE WHEN {g[1]} = 0 AND {g[2]} = 1 THEN 'un millón' WHEN {g[1]} + {g[2]} > 0 THEN concat_ws(' ', {thousands(1)}, 'millones') END"
    return f"x -> CASE WHEN x.digits IS NOT NULL THEN coalesce(nullif(concat_ws(' ', {billions}, {millions}, {thousands(3)}), ''), '{DIGITS[0]}') END"


def integer_words(digits: Column) -> Column:
    """The cardinal of a digit string of at most 15 significant digits, else null."""
    plain = "regexp_replace(d, r'^0+(?=\\d)', '')"
    padded = f"d -> CASE WHEN d RLIKE r'^\\d+$' AND length({plain}) <= 15 THEN lpad({plain}, 15, '0') END"
    groups = ", ".join(f"CAST(substring(p, {k}, 3) AS INT)" for k in range(1, 16, 3))
    bound = f"named_struct('digits', p, 'g', array({groups}), 'small', split('{'|'.join(below_thousand())}', '[|]'))"
    # the list stands in an array made in place: what a transform gives back is copied
    return sql_let(digits, padded, f"p -> get(transform(array({bound}), {_group_words()}), 0)")


#: A literal with thousands groups and decimals: 1 whole part with points, 2 decimals.
LITERAL = r"^(\d+(?:\.\d{3})*)(?:,(\d+))?$"


def whole_digits(literal: Column) -> Column:
    return F.when(literal.rlike(LITERAL), F.replace(F.regexp_extract(literal, LITERAL, 1), F.lit("."), F.lit("")))


def decimals(literal: Column) -> Column:
    return F.regexp_extract(literal, LITERAL, 2)


def decimal_words(literal: Column) -> Column:
    """Whole part in words, then "coma" and the decimals digit by digit; null for other groupings."""
    names, dec = _list(DIGITS), decimals(literal)
    spelled = F.array_join(F.transform(F.split(dec, ""), lambda d: F.get(names, d.try_cast("int"))), " ")
    whole = integer_words(whole_digits(literal))
    return F.when(dec == "", whole).otherwise(F.concat(whole, F.lit(" coma "), spelled))


def letter_name(letter: Column) -> Column:
    return F.try_element_at(_map(LETTERS), F.lower(letter))


def spelled(code: Column) -> Column:
    """Letters and digits one by one."""
    names = {k: v for k, v in LETTERS.items() if k != "ñ"} | {str(i): d for i, d in enumerate(DIGITS)}
    by_code = F.split(F.lit("|".join(names.get(chr(c), "") for c in range(ord("0"), ord("z") + 1))), r"\|")
    return F.array_join(F.transform(F.split(F.lower(code), ""), lambda c: F.nullif(F.get(by_code, F.ascii(c) - ord("0")), F.lit(""))), " ")


def roman_value(roman: Column) -> Column:
    """Subtractive pairs from the left, without a validity check; null for other characters."""
    pairs = {"iv": 4, "ix": 9, "il": 49, "ic": 99, "id": 499, "im": 999, "xl": 40, "xc": 90, "xd": 490, "xm": 990,
             "vx": 5, "vl": 45, "vc": 95, "vd": 495, "vm": 995, "lc": 50, "ld": 450, "lm": 950, "cd": 400, "cm": 900, "dm": 500}
    single = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    values = _map({k: str(v) for k, v in (pairs | single).items()})
    low = F.lower(roman)
    parts = F.regexp_extract_all(low, F.lit("|".join([*pairs, *single])), 0)
    total = F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.try_element_at(values, p).cast("int"))
    return F.when(low.rlike("^[ivxlcdm]+$"), total)


def ordinal_word(number: Column, feminine: Column) -> Column:
    masculine_of = _map({str(i): w for i, w in enumerate(ORDINALS_MASCULINE, 1)})
    feminine_of = _map({str(i): w for i, w in enumerate(ORDINALS_FEMININE, 1)})
    return F.when(feminine, F.try_element_at(feminine_of, number)).otherwise(F.try_element_at(masculine_of, number))


def date_words(day: Column, month: Column, year: Column) -> Column:
    """D de mes de YYYY for a day of the calendar, else null; the year stays in digits."""
    d, m, y = day.try_cast("int"), month.try_cast("int"), year.try_cast("int")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = m.between(1, 12) & (d >= 1) & (d <= last)
    return F.when(ok, F.concat(d.cast("string"), F.lit(" de "), F.get(_list(MONTHS), m - 1), F.lit(" de "), year))
