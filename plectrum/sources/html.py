"""HTML pages to blocks: a small tree from the standard library's tokenizer, then one walk.

Each text node belongs to one block: structural elements end the running block, inline ones pass
through.  ``sanitize="strict"`` keeps allowed elements and unwraps others (their text stays, as a
sanitiser does); ``"passthrough"`` keeps the tree and drops navigation, page headers and the like.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
ALLOWED = frozenset(
    "p b i em strong a ul ol li h1 h2 h3 h4 h5 h6 table thead tbody tr td th blockquote pre code span br hr img figure "
    "figcaption dl dd dt sub sup section article div".split()
)
FORBIDDEN_TAGS = frozenset("script iframe object embed form input textarea select button link meta style".split())
#: Elements that go with their content: the forbidden ones, and those whose text a page does not show.
FORBIDDEN = FORBIDDEN_TAGS | frozenset("noscript template title head".split())
STRUCTURAL = frozenset(
    "body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre figure figcaption caption hr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE_CLASSES = frozenset("sidebar advertisement cookie-banner popup menu navigation".split())
#: Start tags that end an open element of the same kind, up to the boundary.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}),
}
CLOSES_P = STRUCTURAL - {"body", "td", "th", "tr", "thead", "tbody", "caption"} | {"header", "footer", "nav", "form", "aside"}
KINDS = {"li": "list-item", "dt": "list-item", "dd": "list-item", "td": "table-cell", "th": "table-cell", "blockquote": "quote", "pre": "code", "figcaption": "caption", "caption": "caption"} | {
    f"h{i}": "heading" for i in range(1, 7)
}


def _spaced(text: str) -> str:
    """The text with runs of white space and byte order marks as one blank, none at its ends."""
    return " ".join(text.replace("\ufeff", " ").split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", {}, None)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        node, last = self.at, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        elif tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "li", "blockquote", "div", "section", "article"} - {tag})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def tree(source: str) -> Node:
    parser = _Tree()
    parser.feed(source)
    parser.close()
    return parser.root


def _noise(node: Node, in_article: bool) -> bool:
    if node.tag in ("nav", "form") or NOISE_CLASSES & set(node.attrs.get("class", "").split()):
        return True
    return node.tag in ("header", "footer") and not in_article


def blocks(source: str, sanitize: str = "strict") -> Iterator[dict]:
    """type, text, level, list_level and source_ref of each block, in order.  A stack replaces recursion."""
    parts: list[str] = []
    body = ("paragraph", None, None, "body")
    active = body
    out: list[dict] = []

    def flush() -> None:
        said = _spaced("".join(parts))
        parts.clear()
        if said:
            kind, level, list_level, path = active
            out.append({"type": kind, "text": said, "level": level, "list_level": list_level, "source_ref": f"html:{path}"})

    stack: list[tuple] = [("in", tree(source), body, "body", 0, False)]
    while stack:
        what, node, owner, path, depth, in_article = stack.pop()
        if what == "out":
            flush()
            continue
        if isinstance(node, str):
            if active != owner:
                flush()
                active = owner
            parts.append(node)
            continue
        tag = node.tag
        if tag in FORBIDDEN or (sanitize == "passthrough" and _noise(node, in_article)):
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag == "img":
            if alt := node.attrs.get("alt", "").strip():
                if active != owner:
                    flush()
                    active = owner
                parts.append(f" [Imagen: {alt}] ")
            continue
        kept = sanitize == "passthrough" or tag in ALLOWED or tag == "body"
        structural = kept and tag in STRUCTURAL
        following = owner
        if structural:
            flush()
            kind = KINDS.get(tag, owner[0])
            following = (kind, int(tag[1]) if kind == "heading" and tag[0] == "h" else None, max(0, depth - 1) if kind == "list-item" else None, path)
            stack.append(("out", None, None, "", 0, False))
        inside = depth + (tag in ("ul", "ol") and kept)
        below = in_article or tag == "article"
        for i in range(len(node.children) - 1, -1, -1):
            stack.append(("in", node.children[i], following, f"{path}>{tag}[{i}]", inside, below))
    flush()
    return iter(out)


SCHEMA = "doc_id long, ord int, type string, text string, page int, level int, list_level int, source_ref string"


def html_blocks(pages: DataFrame, sanitize: str = "strict") -> DataFrame:
    """Blocks of pages (doc_id, content); parsed in Arrow batches, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, rows = batch.slice(a, 256), []
                for doc, content in zip(part.column("doc_id").to_pylist(), part.column("content").to_pylist(), strict=True):
                    rows += [{"doc_id": doc, "ord": i, "page": 1} | b for i, b in enumerate(blocks(content or "", sanitize))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [("doc_id", pa.int64()), ("ord", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("list_level", pa.int32()), ("source_ref", pa.string())]
)
