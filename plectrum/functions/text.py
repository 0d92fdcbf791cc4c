"""Text primitives with the web platform's meaning of white space, length and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it (fixed value), as the inside of a character class.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Neighbours that are no ASCII letter or digit, and the ASCII word boundary before a word.
LEFT, RIGHT, WORD_START = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])", "(?<![A-Za-z0-9_])"


#: The same characters one by one.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "))


def units(text: Column) -> Column:
    """The length in UTF-16 code units."""
    plain = F.octet_length(text) == F.length(text)  # ASCII alone is not encoded again
    return F.when(plain, F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int"))


def rounded(x: Column, digits: int) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


#: A word: a run of letters and numbers.
WORD = r"[\p{L}\p{N}]+"


def word_tokens(text: Column) -> Column:
    """Runs of letters and numbers of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def fingerprint(content: Column) -> Column:
    """The first 16 bytes of the SHA-256, in hexadecimal."""
    return F.substring(F.sha2(content, 256), 1, 32)


def log_fingerprint(text: Column) -> Column:
    return F.concat(units(text).cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 12))
