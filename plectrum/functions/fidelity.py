"""Critical literals and the check that a rewriting keeps them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plectrum.functions.spanish import let
from plectrum.functions.text import LEFT, RIGHT, SPACE, units

# Legal terms whose loss changes an obligation; case-sensitive.
LEGAL_TERMS = (
    "no deberá", "no podrá", "deberá", "podrá", "salvo que", "excepto", "sin perjuicio de", "siempre que", "antes de",
    "después de", "a más tardar", "dentro de", "queda prohibido", "no obstante", "en ningún caso",
)
_L, _R = r"(?<![\wáéíóúñü])", r"(?![\wáéíóúñü])"
# The patterns of the kinds, in the order that breaks ties of position.
KINDS: tuple[tuple[str, str], ...] = (
    ("number", rf"{LEFT}\d+(?:\.\d{{3}})*(?:,\d+)?{RIGHT}|{LEFT}\d+(?:[.-]\d+)+{RIGHT}"),
    ("ordinal", rf"\d+\.?[{SPACE}]?[ºª°]"),
    ("isin", r"(?<![A-Za-z0-9_])[A-Z]{2}[A-Z0-9]{10}(?![A-Za-z0-9_])"),
    ("lei", r"(?<![A-Za-z0-9_])[A-Z0-9]{20}(?![A-Za-z0-9_])"),
)
#: The terms come after the kinds; each is looked for by itself, since one may stand inside another.
#: The word comes first and its left neighbour is looked at afterwards: a search skips to the word.
_TERM_PATTERNS = tuple(f"{term}(?<!{_L[4:-1]}{term}){_R}" for term in LEGAL_TERMS)
_EMPTY = "array<struct<index:int,rank:int,kind:string,text:string>>"


def _placed(text: Column, kind: str, pattern: Column, rank: Column) -> Column:
    """The hits of one pattern with their UTF-16 places: lengths of the gaps and hits before each."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, 0)

    def one(state: Column, pair: Column) -> Column:
        at = state["at"] + units(pair["gap"])
        token = F.struct(at.alias("index"), rank.alias("rank"), F.lit(kind).alias("kind"), pair["hit"].alias("text"))
        more = F.struct((at + units(pair["hit"])).alias("at"), F.concat(state["tokens"], F.array(token)).alias("tokens"))
        return F.when(pair["hit"].isNull(), state).otherwise(more)  # the gap after the last hit

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("tokens"))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.rlike(text, pattern), F.aggregate(pairs, start, one, lambda s: s["tokens"])).otherwise(F.array().cast(_EMPTY))


def critical_tokens(text: Column) -> Column:
    """array<struct<index, rank, kind, text>> by place, then by kind.

    A term's pattern changes from term to term and is compiled anew each time: only for the terms that a text holds.
    """
    terms = F.array(*[F.struct(F.lit(term).alias("term"), F.lit(p).alias("p"), F.lit(len(KINDS) + i).alias("rank")) for i, (term, p) in enumerate(zip(LEGAL_TERMS, _TERM_PATTERNS, strict=True))])

    def of(own: Column) -> Column:
        found = [_placed(own, kind, F.lit(pattern), F.lit(rank)) for rank, (kind, pattern) in enumerate(KINDS)]
        held = F.filter(terms, lambda t: F.contains(own, t["term"]))
        return F.sort_array(F.concat(*found, F.flatten(F.transform(held, lambda t: _placed(own, "legal-term", t["p"], t["rank"])))))

    return let(text, of)


def standing(tokens: Column) -> Column:
    """The texts of critical literals that stand at boundaries of the text they come from; an ordinal need not."""
    return F.transform(F.filter(tokens, lambda t: t["kind"] != "ordinal"), lambda t: t["text"])


def contains_at_boundary(text: Column, token: Column) -> Column:
    """Whether the literal token stands in text between characters that are no ASCII letters or digits."""
    return (text == token) | F.contains(text, token) & F.rlike(text, F.concat(F.lit(LEFT + r"\Q"), token, F.lit(r"\E" + RIGHT)))


def fidelity(source: Column, spoken: Column, records: Column) -> Column:
    """struct<ok, lost, invented>; records are array<struct<rule, source, replacement>> of preserving rules."""

    def check(x: Column) -> Column:
        def covered(token: Column) -> Column:
            return F.exists(x["records"], lambda r: contains_at_boundary(r["source"], token["text"]))

        # what is among the other text's literals stands there: found without a search of that text
        lost = F.filter(
            x["before"],
            lambda t: ~F.array_contains(x["said"], t["text"])
            & ~contains_at_boundary(x["spoken"], t["text"])
            & ((t["kind"] == "legal-term") | ~covered(t)),
        )
        invented = F.filter(
            x["after"],
            lambda t: ~F.exists(x["before"], lambda s: s["text"] == t["text"])
            & ~contains_at_boundary(x["source"], t["text"])
            & ~F.exists(x["records"], lambda r: contains_at_boundary(r["replacement"], t["text"])),
        )
        return F.struct(((F.size(lost) == 0) & (F.size(invented) == 0)).alias("ok"), lost.alias("lost"), invented.alias("invented"))

    def found(y: Column) -> Column:
        return let(F.struct(*[y[c].alias(c) for c in ("source", "spoken", "records", "before", "after")], standing(y["after"]).alias("said")), check)

    bound = F.struct(
        source.alias("source"), spoken.alias("spoken"), records.alias("records"),
        critical_tokens(source).alias("before"), critical_tokens(spoken).alias("after"),
    )
    return let(bound, found)
