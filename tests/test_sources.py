"""Formats, archives, page layout, audio files and Markdown on small inputs with known results."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plectrum.plans.files import docx_file, epub_file
from plectrum.sources import archives, formats, html, layout, markdown, text, wav


def test_formats_by_name_type_and_magic(spark):
    rows = [
        ("a.PDF", "text/plain", b"PK\x03\x04", "pdf", None), ("b", "text/markdown", b"", "markdown", "unsupported_type"), ("c", "", b"%PDF-1", "pdf", "unsupported_type"), ("d.zip", "", b"PK\x03\x04", None, "unsupported_type"),
        ("e.markdown", "text/x-markdown", None, "markdown", None), ("f.htm", "application/xhtml+xml", b"", "html", "unsupported_type"), ("g.text", None, b"", "txt", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "name string, mime string, head binary")
    got = df.select("name", formats.detect_format(F.col("name"), F.col("mime"), F.col("head")).alias("f"), formats.reject_reason(F.col("name"), F.col("mime"), F.lit(9)).alias("r")).collect()
    assert {g["name"]: (g["f"], g["r"]) for g in got} == {r[0]: r[3:] for r in rows}
    sizes = df.limit(1).select(formats.reject_reason(F.lit("a.txt"), F.lit(""), F.lit(0)), formats.reject_reason(F.lit("a.txt"), F.lit(""), F.lit(50 * 1024 * 1024 + 1)))
    assert tuple(sizes.first()) == ("empty_file", "file_too_large")


def test_preflight_in_the_order_of_the_checks(spark):
    mib = 1 << 20
    entries = {
        "ok": [("a", False, 10, 5), ("d/", True, 0, 0), ("unknown", False, -1, -1)], "path": [("a", False, 100 * mib, 1), ("\\\\x", False, 1, 1)], "drive": [("C:/x", False, 1, 1)],
        "total": [(f"e{i}", False, 60 * mib, 60 * mib) for i in range(5)], "ratio": [("a", False, 101, 1)], "fine": [("a", False, 100, 1)],
    }
    rows = [(k, i, *e) for k, own in entries.items() for i, e in enumerate(own)]
    df = spark.createDataFrame(rows, "a string, ord int, name string, is_dir boolean, size long, packed long")
    got = {r["a"]: r["problem"] for r in formats.zip_preflight(df, "a").collect()}
    assert got == {"ok": None, "path": "entry_too_large", "drive": "unsafe_path", "total": "total_too_large", "ratio": "extreme_ratio", "fine": None}
    many = spark.range(10_001).select(F.lit("m").alias("a"), F.col("id").alias("ord"), F.lit("/x").alias("name"), F.lit(False).alias("is_dir"), F.lit(1).alias("size"), F.lit(1).alias("packed"))
    assert formats.zip_preflight(many, "a").first()["problem"] == "too_many_entries"


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def test_word_files(spark):
    lines = ["one & two", "<three>"]
    got = list(archives.docx_blocks_of(docx_file("Title", lines)))
    assert [(b["type"], b["text"]) for b in got] == [("heading", "Title"), ("paragraph", lines[0]), ("paragraph", lines[1]), *(("table-cell", t) for t in ("Lines", "Units", "2", "16"))]
    assert got[0]["level"] == 2 and got[3]["source_ref"].endswith("cell[0]#h") and got[5]["source_ref"].endswith("cell[2]")
    files = spark.createDataFrame([(1, docx_file("T", [])), (2, b"no archive"), (3, None), (4, packed(a="x"))], "doc_id long, content binary")
    bad = {r["doc_id"]: r["text"] for r in archives.docx_blocks(files).where("type = 'error'").collect()}
    assert bad == {2: "not_an_archive", 3: "not_an_archive", 4: "missing_entry word/document.xml"}


def test_archives_within_limits():
    bomb = packed(**{"word__document.xml": "<x>" + " " * 3_000_000 + "</x>"})
    with pytest.raises(archives.Rejected, match="extreme_ratio"):
        archives.Archive(bomb)
    with pytest.raises(archives.Rejected, match="entry_too_large"):
        archives.Archive(bomb, formats.ZipLimits(entry_bytes=1000))
    with pytest.raises(archives.Rejected, match="unsafe_path"):
        archives.Archive(packed(**{"__etc__x": "y"}))
    assert archives.directory(packed(a="xx"))[0] | {"packed": 0} == {"ord": 0, "name": "a", "is_dir": False, "size": 2, "packed": 0}


def test_books():
    data = epub_file("First part", ["the second", "of all  lines"])
    rows = list(archives.epub_blocks_of(data))
    assert [(r["type"], r["text"], r["page"]) for r in rows] == [("heading", "First part", 1), ("paragraph", "the second", 3), ("heading", "of all lines", 3)]
    assert rows[1]["source_ref"] == "OEBPS/c.xhtml#p0"
    book = archives.book_parts(data)
    assert book["meta"] == {"title": "T", "author": "A, B", "language": "es", "dir": None} and book["skipped"] == 1
    assert archives.book_toc(data) == [("First part", 0, 0), ("Lines", 1, 1)]
    locked = '<encryption xmlns:e="http://www.w3.org/2001/04/xmlenc#"><e:EncryptedData><e:EncryptionMethod Algorithm="{}"/><e:CipherData><e:CipherReference URI="{}"/></e:CipherData></e:EncryptedData></encryption>'
    for how, uri, refused in (("x", "OEBPS/c.xhtml", True), (archives.FONT_SCRAMBLERS[0], "OEBPS/c.xhtml", False), ("x", "f.ttf", False)):
        out = io.BytesIO(data)
        with zipfile.ZipFile(out, "a") as z:
            z.writestr("META-INF/encryption.xml", locked.format(how, uri))
        if refused:
            with pytest.raises(archives.Rejected, match="protected"):
                archives.book_parts(out.getvalue())
        else:
            assert archives.book_parts(out.getvalue())["sections"]


ITEMS = "doc_id long, page long, page_width double, page_height double, seq long, str string, x double, y_top double, width double, height double"


def test_layout_lines_and_blocks(spark):
    page = [
        ("Big", 50, 100, 30, 20), ("title", 95, 101, 30, 20),  # a heading; the gap of 15 is a blank
        ("body ", 50, 140, 40, 10), ("text", 90, 144, 30, 10), ("goes", 50, 156, 30, 10), ("on", 50, 168, 20, 10),  # one paragraph
        ("- item", 50, 180, 40, 10), ("(a) item", 50, 192, 40, 10), ("far", 200, 300, 20, 10), ("note", 50, 400, 20, 7), ("head", 50, 20, 20, 9), ("pág. 3 de 7", 50, 950, 20, 9), ("Foot", 50, 980, 20, 9), ("  ", 1, 1, 1, 1),
    ]
    rows = [(1, 1, 600.0, 1000.0, i, s, float(x), float(y), float(w), float(h)) for i, (s, x, y, w, h) in enumerate(page)]
    got = layout.blocks(spark.createDataFrame(rows, ITEMS).repartition(3)).orderBy("ord").collect()
    assert [(r["type"], r["text"], r["level"]) for r in got] == [
        ("page-header", "head", None), ("heading", "Big title", 1), ("paragraph", "body text goes on", None), ("list-item", "- item (a) item", None), ("paragraph", "far", None),
        ("footnote", "note", None), ("page-number", "pág. 3 de 7", None), ("page-footer", "Foot", None),
    ]
    assert got[1]["box"] == [50.0, 100.0, 125.0, 120.0]
    assert layout.blocks(spark.createDataFrame([], ITEMS)).count() == 0


def test_layout_lines_hang_on_their_first_item(spark):
    # each item is near the one before it, but the third is too far from the first
    rows = [(1, 1, 600.0, 1000.0, i, str(i), 10.0 * i, 100.0 + 4 * i, 5.0, 10.0) for i in range(3)]
    assert [r["text"] for r in layout.lines(spark.createDataFrame(rows, ITEMS)).orderBy("line").collect()] == ["0 1", "2"]


def test_wav(spark):
    data = wav.tone("x" * 150)
    assert wav.duration_ms(data) == 1500 and len(data) == 44 + 2 * 12_000
    assert wav.duration_ms(b"RIFF") is None and wav.duration_ms(b"x" * 60) is None and wav.duration_ms(None) is None
    odd = data[:12] + b"LIST\x03\x00\x00\x00abc\x00" + data[12:]
    assert wav.duration_ms(odd) == 1500
    samples, rate = wav.decode(data)
    assert rate == 8000 and samples.shape == (12_000, 1) and wav.duration_ms(wav.joined([data, data])) == 3000
    double = wav.encode(np.repeat(samples, 2, axis=1), 16_000)
    assert wav.decode(wav.joined([data, double]))[0].shape == (24_000 + 12_000, 2)
    quiet = np.concatenate([np.zeros((4000, 1)), samples[:800], np.zeros((4000, 1))])
    assert 800 <= len(wav.trimmed(quiet, rate)) <= 800 + 160 + 400 and len(wav.trimmed(np.zeros((10, 1)), rate)) == 10
    assert wav.encode(np.array([[-2.0], [2.0]]), 8000)[44:] == b"\x00\x80\xff\x7f"


def test_markdown_tables_and_quotes():
    source = "| a | `code` **b** |\n|---|---|\n| c ![x](y) | [d](e) |\n\n> one `two`\n> *three*"
    got = [(b["type"], b["text"]) for b in markdown.blocks(source)]
    assert got == [("paragraph", "a   b c  d"), ("quote", "one  two   three")]


def test_adapters(spark):
    formats.register_adapter("html", html.html_blocks)
    formats.register_adapter("markdown", markdown.markdown_blocks)
    files = [(1, "a.html", "", b"<p>x</p>"), (2, "b.md", "", b"# y"), (3, "c.bin", "", b"z")]
    df = spark.createDataFrame(files, "doc_id long, name string, mime string, content binary")
    as_text = df.withColumn("content", F.decode("content", "UTF-8"))
    got = formats.blocks_of(as_text.withColumn("content", F.col("content"))).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["type"], r["text"]) for r in got] == [(1, "paragraph", "x"), (2, "heading", "y")]
    assert formats.adapter_for("html") is html.html_blocks and formats.adapter_for("pdf") is None


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "s", "a\n\nb"), (2, "s", None)], "doc_id long, source string, text string")
    assert [(r["doc_id"], r["ord"], r["text"]) for r in text.line_blocks(df).orderBy("doc_id", "ord").collect()] == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "")]
