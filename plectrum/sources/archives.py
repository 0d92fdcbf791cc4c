"""Word-processor files and books: archives of XML to blocks, behind the limits on archives.

An archive's directory is checked before anything is inflated, and an entry is inflated no further than
the limit, whatever its directory says.  A file that breaks a rule or cannot be read gives one row of
type ``error`` whose text is the reason, so one bad file stops no job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectrum.sources.formats import ZipLimits
from plectrum.sources.html import Node, tree

SCHEMA = "doc_id long, ord int, type string, text string, page int, level int, list_level int, source_ref string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("ord", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("list_level", pa.int32()), ("source_ref", pa.string())]
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_UNSAFE = re.compile(r"^(?:/|[A-Za-z]:[/\\]|\\\\)")
# Encryption that only scrambles fonts, readable parts, and the elements whose text is a block of a book.
FONT_SCRAMBLERS = ("http://www.idpf.org/2008/embedding/font-obf", "http://ns.adobe.com/pdf/enc#RC")
_CONTENT = re.compile(r"\.(?:x?html?|svg)(?:\?|#|$)", re.IGNORECASE)
BOOK_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th figcaption caption dt dd".split())


class Rejected(ValueError):
    """A file that must not or cannot be read; the message is the reason."""


class Archive:
    """The entries of a zip file within limits."""

    def __init__(self, data: bytes, limits: ZipLimits = ZipLimits()) -> None:
        self.limits, self._total = limits, 0
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            raise Rejected("not_an_archive") from e
        entries = self._zip.infolist()
        if len(entries) > limits.entries:
            raise Rejected("too_many_entries")
        files = [e for e in entries if not e.is_dir()]
        for e in files:
            if _UNSAFE.match(e.filename) or _UNSAFE.match(e.orig_filename):
                raise Rejected("unsafe_path")
            if e.file_size > limits.entry_bytes:
                raise Rejected("entry_too_large")
        if sum(e.file_size for e in files) > limits.total_bytes:
            raise Rejected("total_too_large")
        if any(e.compress_size > 0 and e.file_size / e.compress_size > limits.ratio for e in files):
            raise Rejected("extreme_ratio")
        self._names = {e.filename: e for e in files}

    def __contains__(self, name: str) -> bool:
        return name in self._names

    def read(self, name: str) -> bytes:
        if name not in self._names:
            raise Rejected(f"missing_entry {name}")
        try:
            with self._zip.open(self._names[name]) as f:
                out = f.read(self.limits.entry_bytes + 1)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as e:
            raise Rejected(f"unreadable_entry {name}") from e
        self._total += len(out)
        if len(out) > self.limits.entry_bytes or self._total > self.limits.total_bytes:
            raise Rejected("inflated_too_far")
        return out

    def xml(self, name: str) -> ET.Element:
        try:
            return ET.fromstring(self.read(name))
        except ET.ParseError as e:
            raise Rejected(f"bad_xml {name}") from e


def directory(content: bytes | None) -> list[dict]:
    """The central directory of an archive as rows for the preflight; none if it cannot be read."""
    try:
        entries = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
    except (zipfile.BadZipFile, ValueError):
        return []
    return [{"ord": i, "name": e.filename, "is_dir": e.is_dir(), "size": e.file_size, "packed": e.compress_size} for i, e in enumerate(entries)]


# --- word-processor files ---------------------------------------------------------------------------


def _run_text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append(" ")
    return "".join(out).strip()


def _image(node: ET.Element) -> str:
    for x in node.iter():
        if x.tag.endswith("}docPr") and (x.get("descr") or "").strip():
            return f"[Imagen: {x.get('descr').strip()}]"
    return ""


def docx_blocks_of(data: bytes, limits: ZipLimits = ZipLimits()) -> Iterator[dict]:
    """Headings, paragraphs, list items and table cells in document order.

    Cells are numbered along a table, those of marked header rows with ``#h``; an empty paragraph with a described
    image speaks the description.
    """
    archive = Archive(data, limits)
    body = archive.xml("word/document.xml").find(_W + "body")
    names = {}
    if "word/styles.xml" in archive:
        for style in archive.xml("word/styles.xml").iter(_W + "style"):
            name = style.find(_W + "name")
            names[style.get(_W + "styleId")] = (name.get(_W + "val") if name is not None else "") or ""
    places: dict[str, int] = {}

    def place(kind: str) -> str:
        places["n"] = places.get("n", -1) + 1
        return f"docx:body>{kind}[{places['n']}]"

    for node in [] if body is None else body:
        if node.tag == _W + "p":
            text = _run_text(node) or _image(node)
            style = node.find(f"{_W}pPr/{_W}pStyle")
            named = (names.get(style.get(_W + "val"), style.get(_W + "val") or "") if style is not None else "").lower()
            number = node.find(f"{_W}pPr/{_W}numPr")
            if m := re.match(r"heading ?([1-6])$", named):
                kind, more = "heading", {"level": int(m[1])}
            elif number is not None or named.startswith("list "):
                level = number.find(_W + "ilvl") if number is not None else None
                kind, more = "list-item", {"list_level": int(level.get(_W + "val")) if level is not None else 0}
            elif "quote" in named:
                kind, more = "quote", {}
            elif named == "caption":
                kind, more = "caption", {}
            else:
                kind, more = "paragraph", {}
            ref = place({"heading": f"h{more.get('level')}", "list-item": "li", "quote": "blockquote"}.get(kind, "p"))
            if text:
                yield {"type": kind, "text": text, "source_ref": ref} | more
        elif node.tag == _W + "tbl":
            ref, at = place("table"), 0
            for row in node.iter(_W + "tr"):
                head = row.find(f"{_W}trPr/{_W}tblHeader") is not None
                for cell in row.findall(_W + "tc"):
                    text = " ".join(t for t in (_run_text(p) for p in cell.iter(_W + "p")) if t) or _image(cell)
                    if text:
                        yield {"type": "table-cell", "text": text, "source_ref": f"{ref}>cell[{at}]{'#h' if head else ''}"}
                    at += 1


# --- books ------------------------------------------------------------------------------------------


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if _local(x) == name]


def _reject_encrypted(archive: Archive) -> None:
    """Readable parts under any encryption but font scrambling are protected and not opened."""
    if "META-INF/encryption.xml" not in archive:
        return
    for data in _all(archive.xml("META-INF/encryption.xml"), "EncryptedData"):
        how = next((x.get("Algorithm") for x in _all(data, "EncryptionMethod")), None)
        uri = next((x.get("URI") for x in _all(data, "CipherReference")), None)
        if uri and _CONTENT.search(uri) and how not in FONT_SCRAMBLERS:
            raise Rejected("protected")


def _own_texts(root: Node) -> list[str]:
    """The text of each block element in document order, without that of block elements inside it."""
    order: list[Node] = []
    texts: dict[int, list[str]] = {}
    loose: list[str] = []

    def walk(node: Node, owner: Node | None) -> None:
        if node.tag in ("script", "style", "noscript"):
            return
        if node.tag in BOOK_BLOCKS:
            owner = node
            order.append(node)
            texts[id(node)] = []
        for child in node.children:
            if isinstance(child, str):
                if said := child.strip():
                    loose.append(said)
                    if owner is not None:
                        texts[id(owner)].append(said)
            else:
                walk(child, owner)

    walk(root, None)
    joined = [re.sub(r"\s+", " ", " ".join(texts[id(n)])).strip() for n in order]
    found = [t for t in joined if t]
    whole = re.sub(r"\s+", " ", " ".join(loose)).strip()
    return found or ([whole] if whole else [])


def book_parts(data: bytes, limits: ZipLimits = ZipLimits()) -> dict:
    """metadata (title, author, language, dir), sections [(path, index, [texts])], skipped and toc [(label, depth, href)]."""
    archive = Archive(data, limits)
    _reject_encrypted(archive)
    root = next((x.get("full-path") for x in _all(archive.xml("META-INF/container.xml"), "rootfile")), None)
    if not root:
        raise Rejected("no_package")
    package = archive.xml(root)
    base = posixpath.dirname(root)
    at = lambda href: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
    said = lambda name: [t for x in _all(package, name) if (t := "".join(x.itertext()).strip())]
    spine = next(iter(_all(package, "spine")), None)
    items = {x.get("id"): x for x in _all(package, "item")}
    meta = {"title": next(iter(said("title")), None), "author": ", ".join(said("creator")) or None, "language": next(iter(said("language")), None)}
    meta["dir"] = "rtl" if spine is not None and spine.get("page-progression-direction") == "rtl" else None
    sections, skipped = [], 0
    for i, ref in enumerate([] if spine is None else _all(spine, "itemref")):
        if ref.get("linear") == "no":
            continue
        item = items.get(ref.get("idref"))
        try:
            path = at(item.get("href"))
            texts = _own_texts(tree(archive.read(path).decode("utf-8-sig", "replace")))
        except (Rejected, AttributeError, RecursionError) as e:
            if str(e) == "inflated_too_far":
                raise
            skipped += 1
            continue
        if texts:
            sections.append((path, i, texts))
        else:
            skipped += 1
    return {"meta": meta, "sections": sections, "skipped": skipped, "toc": _toc(archive, package, items, spine, at)}


def _toc(archive: Archive, package: ET.Element, items: dict, spine: ET.Element | None, at: Callable[[str], str]) -> list[tuple[str, int, str]]:
    """Contents entries in order with their depth: from the navigation document, else from the older index."""
    out: list[tuple[str, int, str]] = []
    nav = next((x for x in items.values() if "nav" in (x.get("properties") or "").split()), None)
    ncx = items.get(spine.get("toc")) if spine is not None else None
    clean = lambda x: " ".join("".join(x.itertext()).split())

    def from_list(node: ET.Element, depth: int, folder: str) -> None:
        for li in [x for x in node if _local(x) == "li"]:
            link = next((x for x in li if _local(x) in ("a", "span")), None)
            if link is not None and clean(link) and link.get("href"):
                out.append((clean(link), depth, posixpath.normpath(posixpath.join(folder, link.get("href")))))
            for inner in [x for x in li if _local(x) == "ol"]:
                from_list(inner, depth + 1, folder)

    def from_points(node: ET.Element, depth: int, folder: str) -> None:
        for point in [x for x in node if _local(x) == "navPoint"]:
            label = next((clean(x) for x in point if _local(x) == "navLabel"), "")
            src = next((x.get("src") for x in point if _local(x) == "content"), None)
            if label and src:
                out.append((label, depth, posixpath.normpath(posixpath.join(folder, src))))
            from_points(point, depth + 1, folder)

    try:
        if nav is not None:
            path = at(nav.get("href"))
            for x in _all(archive.xml(path), "nav"):
                if any(k.rpartition("}")[2] == "type" and v == "toc" for k, v in x.attrib.items()):
                    for ol in [y for y in x if _local(y) == "ol"]:
                        from_list(ol, 0, posixpath.dirname(path))
        elif ncx is not None:
            path = at(ncx.get("href"))
            for x in _all(archive.xml(path), "navMap"):
                from_points(x, 0, posixpath.dirname(path))
    except Rejected:
        return []
    return out


def epub_blocks_of(data: bytes, limits: ZipLimits = ZipLimits()) -> Iterator[dict]:
    """Every block element of every readable section; blocks where a contents label begins are headings."""
    book = book_parts(data, limits)
    rows = [
        {"type": "paragraph", "text": text, "page": i + 1, "source_ref": f"{path}#p{k}"}
        for path, i, texts in book["sections"] for k, text in enumerate(texts)
    ]
    if not rows:
        raise Rejected("no_readable_text")
    low = [r["text"].lower() for r in rows]
    for label, _, _ in book["toc"]:
        hit = next((k for k, t in enumerate(low) if label.lower()[:30] in t), None)
        if hit is not None:
            rows[hit] |= {"type": "heading", "level": 1}
    yield from rows


def book_toc(data: bytes, limits: ZipLimits = ZipLimits()) -> list[tuple[str, int, int]]:
    """(label, depth, block_index): links to sections without a block go to the first block."""
    book, first, at = book_parts(data, limits), {}, 0
    for path, _, texts in book["sections"]:
        first.setdefault(path, at)
        at += len(texts)
    return [(label, depth, 0 if href.lower().startswith("epubcfi(") else first.get(unquote(href.split("#")[0]), 0)) for label, depth, href in book["toc"]]


# --- tables -----------------------------------------------------------------------------------------


def _parsed(docs: DataFrame, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list(parse(content or b""))
                except Rejected as e:
                    rows = [{"type": "error", "text": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "ord": i, "page": 1} | r for i, r in enumerate(rows)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, SCHEMA)


def docx_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of word-processor files (doc_id, content), parsed in Arrow batches."""
    return _parsed(docs, docx_blocks_of)


def epub_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of books (doc_id, content), parsed in Arrow batches."""
    return _parsed(docs, epub_blocks_of)


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, ord, name, is_dir, size, packed of the archives' directories, the input of the preflight."""
    schema = pa.schema([("doc_id", pa.int64()), ("ord", pa.int64()), ("name", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("packed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if rows := directory(content):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc} | r for r in rows], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, ord long, name string, is_dir boolean, size long, packed long")
