"""Spanish or English by marker words and accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plectrum.functions.text import SPACE

# Marker words (two with capitals never match lower-cased text).
SPANISH = "de del la el los las un una que por con para artículo disposición boletín oficial ciento euros ley Real España es al se".split()
ENGLISH = "the of and a to in that is for with article section shall must percent united this from be on".split()
ACCENTS = "áéíóúñ¿¡"


def _score(hay: Column, markers: list[str]) -> Column:
    """How often the markers stand between blanks, each by itself, without overlap.

    Two of a marker in a row share their blank, so of a run of n only every second one counts; all markers are
    found in one scan, and half of each run is taken off by a second.
    """
    any_of = "|".join(markers)
    found, twice = F.regexp_count(hay, F.lit(f" (?:{any_of})(?= )")), F.regexp_count(hay, F.lit(f" ({any_of}) \\1(?= )"))
    return (found - twice).cast("long")


def scores(text: Column) -> tuple[Column, Column]:
    hay = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "), F.lit(" "))
    accents = F.length(hay) - F.length(F.translate(hay, ACCENTS, ""))
    return _score(hay, SPANISH) + 2 * accents, _score(hay, ENGLISH)


def detect(text: Column) -> Column:
    spanish, english = scores(text)
    return F.when(spanish >= english, "es").otherwise("en")
