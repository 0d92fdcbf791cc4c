"""Markdown to blocks: headings, paragraphs, code, quotes, lists, tables and rules, line by line."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectrum.sources.html import ARROW, SCHEMA

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"^( *)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]*\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_CODE = re.compile(r"(`+)(.+?)\1")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_MARKS = re.compile(r"(\*\*|__|\*|~~|(?<!\w)_|_(?!\w))(?=\S)(.+?)(?<=\S)\1")


def _runs(text: str, code: Callable[[str], str], image: Callable[[re.Match], str], mark: str) -> str:
    """The text without its markup, with ``mark`` where some was; a pattern is looked for only where its characters stand."""
    if "`" in text:
        text = _CODE.sub(lambda m: code(m[2].strip() or m[2]), text)
    if "](" in text:
        text = _LINK.sub(rf"{mark}\1{mark}", _IMAGE.sub(image, text))
    before = None
    while before != text and ("*" in text or "_" in text or "~~" in text):
        before, text = text, _MARKS.sub(rf"{mark}\2{mark}", text)
    return text


def _plain(text: str, held: list[str]) -> str:
    """The text with its escapes opened and the held code back."""
    if "\\" in text:
        text = _ESCAPED.sub(r"\1", text)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text) if held else text


def inline(text: str) -> str:
    """The spoken text of inline markup: marks go, code stays, images give their description."""
    held: list[str] = []

    def hold(code: str) -> str:
        held.append(code)
        return f"\x00{len(held) - 1}\x00"

    return _plain(_runs(text, hold, lambda m: f"[Imagen: {m[1]}]" if m[1] else "", ""), held)


def nodes(text: str, code: bool) -> list[str]:
    """The plain runs between inline markup; code spans are runs too, or drop out, and so do images."""
    held: list[str] = []

    def keep(run: str) -> str:
        held.append(run)
        return f"\x01\x00{len(held) - 1}\x00\x01"

    return [_plain(r, held) for r in _runs(text, keep if code else lambda _: "\x01", lambda _: "\x01", "\x01").split("\x01") if r]


def blocks(source: str) -> Iterator[dict]:
    lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, n = 0, len(lines)

    def made(kind: str, text: str, a: int, b: int, **more) -> dict:
        return {"type": kind, "text": text, "source_ref": f"L{a + 1}-L{b}"} | more

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            a, i, held = i, i + 1, []
            while i < n and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i]):
                held.append(lines[i])
                i += 1
            i = min(n, i + 1)
            yield made("code", "\n".join(held), a, i)
        elif _RULE.match(line):
            i += 1
            yield {"type": "separator", "text": "", "source_ref": None}
        elif m := _HEADING.match(line):
            i += 1
            yield made("heading", inline(m[2] or ""), i - 1, i, level=len(m[1]))
        elif _QUOTE.match(line):
            a, held = i, []
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or held):
                held.append(_QUOTE.sub("", lines[i]).strip())
                i += 1
            # every run, and every line break as a blank of its own, joined by blanks
            runs = [r for k, h in enumerate(h for h in held if h) for r in ([" "] if k else []) + nodes(h, code=True)]
            yield made("quote", " ".join(runs).strip(), a, i)
        elif m := _ITEM.match(line):
            depths: list[int] = []
            while i < n and (m := _ITEM.match(lines[i])):
                a, indent, held = i, len(m[1]), [m[2] or ""]
                i += 1
                while depths and indent <= depths[-1]:
                    depths.pop()
                depths.append(indent)
                while i < n and lines[i].strip() and not _ITEM.match(lines[i]):
                    held.append(lines[i].strip())
                    i += 1
                yield made("list-item", inline(" ".join(held)), a, i, list_level=len(depths) - 1)
                while i < n and not lines[i].strip() and i + 1 < n and _ITEM.match(lines[i + 1]):
                    i += 1
        elif "|" in line and i + 1 < n and _DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1]:
            a, cells = i, []
            while i < n and lines[i].strip() and "|" in lines[i]:
                if i != a + 1:
                    cells += [r for c in re.split(r"(?<!\\)\|", lines[i].strip().strip("|")) for r in nodes(c.strip(), code=False)]
                i += 1
            if said := " ".join(cells).strip():
                yield made("paragraph", said, a, i)
        elif re.match(r"^(?: {4}|\t)", line):
            a, held = i, []
            while i < n and (re.match(r"^(?: {4}|\t)", lines[i]) or not lines[i].strip()):
                held.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                i += 1
            yield made("code", "\n".join(held).rstrip("\n"), a, i)
        else:
            a, held = i, []
            while i < n and lines[i].strip() and not (held and (_FENCE.match(lines[i]) or _HEADING.match(lines[i]) or _RULE.match(lines[i]) or _QUOTE.match(lines[i]))):
                if held and re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[i]):
                    break
                held.append(lines[i])
                i += 1
            level = 0
            if i < n and held and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[i])):
                level, i = 1 if m[1][0] == "=" else 2, i + 1
            # two spaces or a backslash at the end break the line, else it goes on
            said = "".join(h.strip().rstrip("\\") + ("\n" if h.endswith(("  ", "\\")) else " ") for h in held).strip()
            yield made("heading", inline(said), a, i, level=level) if level else made("paragraph", inline(said), a, i)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts (doc_id, content), parsed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, rows = batch.slice(a, 256), []
                for doc, content in zip(part.column("doc_id").to_pylist(), part.column("content").to_pylist(), strict=True):
                    rows += [{"doc_id": doc, "ord": i, "page": 1} | b for i, b in enumerate(blocks(content or ""))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, SCHEMA)
