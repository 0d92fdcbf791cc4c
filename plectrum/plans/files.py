"""Queries on formats, archives, layout and audio files, each with its DuckDB twin beside it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.session import fresh_folder
from plectrum.sources import archives, folder, formats, html, layout, markdown, wav
from plectrum.sources.text import decoded
from plectrum.plans.shared import Registered, table

REGISTERED = Registered()
query = REGISTERED.query

#: Extensions and types given to the pages by their number.
_NAMES = (".pdf", ".EPUB", ".docx", ".text", ".mkd", ".htm", ".bin", "", ".zip")
_MIMES = ("", "application/pdf", "text/html", "text/x-markdown", "application/zip", "text/plain", "application/epub+zip")


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    f"""
with f as (select page_id, 'p.' || page_id || ({_sql_list(_NAMES)})[page_id % 9 + 1] as name, ({_sql_list(_MIMES)})[page_id % 7 + 1] as mime,
  case page_id % 4 when 0 then '%PDF-1.7' when 1 then 'PK' || chr(3) || chr(4) else html end as head, length(html) * case when page_id % 50 = 7 then 0 when page_id % 50 = 8 then 100000 else 1 end as size from pages),
d as (select *, lower(regexp_extract(name, '(\\.[A-Za-z]+)?$')) as ext from f),
t as (select *, case ext when '.pdf' then 'pdf' when '.epub' then 'epub' when '.docx' then 'docx' when '.text' then 'txt' when '.mkd' then 'markdown' when '.htm' then 'html'
  else case mime when 'application/pdf' then 'pdf' when 'application/epub+zip' then 'epub' when 'text/plain' then 'txt' when 'text/html' then 'html' else case when head[1:4] = '%PDF' then 'pdf' end end end as format from d)
select page_id, format, case when size = 0 then 'empty_file' when size > 52428800 then 'file_too_large' when ext in ('.bin', '', '.zip') or mime = 'application/zip' then 'unsupported_type' end as rejected,
  head[1:5] = '%PDF-' as pdf_magic, head[1:4] = 'PK' || chr(3) || chr(4) as zip_magic, coalesce(format, 'unknown') as label,
  case format when 'markdown' then 'Markdown' when 'pdf' then 'PDF' when 'epub' then 'EPUB' when 'docx' then 'DOCX' when 'html' then 'HTML' when 'txt' then 'TXT' else upper(list_extract(string_split(name, '.'), -1)) end as shown from t"""
)
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, refusal, magic and labels of the pages under made-up names and types."""
    k = F.col("page_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    head = F.when(k % 4 == 0, F.lit("%PDF-1.7")).when(k % 4 == 1, F.lit("PK\x03\x04")).otherwise(F.col("html"))
    size = F.length("html").cast("long") * F.when(k % 50 == 7, 0).when(k % 50 == 8, 100_000).otherwise(1)
    name = F.concat(F.lit("p."), k.cast("string"), pick(_NAMES, 9))
    files = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), pick(_MIMES, 7).alias("mime"), F.substring(F.encode(head, "UTF-8"), 1, 8).alias("head"), size.alias("size"))
    fmt = formats.detect_format(F.col("name"), F.col("mime"), F.col("head"))
    parser = F.concat(F.lit("own-"), F.coalesce(F.col("format"), F.lit("none")))
    return files.withColumn("format", fmt).select(
        "page_id", "format", formats.reject_reason(F.col("name"), F.col("mime"), F.col("size")).alias("rejected"), formats.has_pdf_magic(F.col("head")).alias("pdf_magic"),
        formats.has_zip_magic(F.col("head")).alias("zip_magic"), formats.type_label(parser).alias("label"), formats.shown_label(parser, F.col("name")).alias("shown"),
    )


@query(
    """
select l_orderkey, l_linenumber,
  case f when 'mp3' then 'audio/mpeg' when 'wav' then 'audio/wav' when 'opus' then 'audio/opus' when 'flac' then 'audio/flac' when 'pcm' then 'audio/L16;rate=24000' else 'application/octet-stream' end as request_mime,
  case f when 'wav' then 'audio/wav' when 'mp3' then 'audio/mpeg' when 'm4a' then 'audio/mp4' end as export_mime
from (select *, (['mp3', 'wav', 'opus', 'flac', 'pcm', 'm4a'])[l_linenumber % 6 + 1] as f from lineitem)"""
)
def audio_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.element_at(F.array(*map(F.lit, ("mp3", "wav", "opus", "flac", "pcm", "m4a"))), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.audio_mime(fmt).alias("request_mime"), formats.export_mime(fmt).alias("export_mime"))


@query(
    """
with e as (select l_orderkey, (l_linenumber, l_partkey, l_suppkey) as ord, l_returnflag = 'R' as is_dir, l_partkey * l_partkey * 40 as size, l_suppkey * 50000 as packed,
  case when l_partkey % 211 = 0 then '/etc/x' when l_partkey % 223 = 0 then 'C:\\x' when l_partkey % 227 = 0 then '\\\\srv\\x' else 'a/b.xml' end as name from lineitem),
k as (select *, case when not is_dir and (starts_with(name, '/') or starts_with(name, 'C:') or starts_with(name, '\\\\')) then 'unsafe_path' when not is_dir and size > 67108864 then 'entry_too_large' end as own from e),
s as (select l_orderkey, count(*) as n_entries, coalesce(sum(case when not is_dir then size end), 0)::bigint as total_bytes, max(case when not is_dir then size end) as largest_entry,
  max(case when not is_dir and packed > 0 then size / packed end) as worst, arg_min(own, ord) as own from k group by 1)
select l_orderkey, n_entries, total_bytes, largest_entry, floor(worst * 1000 + 0.5) / 1000 as largest_ratio,
  case when own is not null then own when total_bytes > 268435456 then 'total_too_large' when worst > 100 then 'extreme_ratio' end as problem from s"""
)
def zip_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the directory of an archive an order."""
    part = F.col("l_partkey")
    name = F.when(part % 211 == 0, "/etc/x").when(part % 223 == 0, "C:\\x").when(part % 227 == 0, "\\\\srv\\x").otherwise("a/b.xml")
    entries = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", part, "l_suppkey").alias("ord"), name.alias("name"), (F.col("l_returnflag") == "R").alias("is_dir"), (part * part * 40).alias("size"), (F.col("l_suppkey") * 50_000).alias("packed")
    )
    return formats.zip_preflight(entries, "l_orderkey")


@query(
    """
with n as (select item_id, text, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) as n from benchmark where trim(text) <> ''),
s as (select item_id, floor(8000 * least(3.0, greatest(1.0, n * 0.01::double)))::bigint as samples from n)
select item_id, 44 + 2 * samples as n_bytes, floor(samples * 2 / 16000 * 1000 + 0.5)::bigint as duration_ms from s"""
)
def mock_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test audio of each benchmark text, and its duration read back from the bytes."""
    made = wav.with_audio(table(spark, sf_dir, "benchmark"), "text").where("audio IS NOT NULL")
    return made.select("item_id", F.octet_length("audio").cast("long").alias("n_bytes"), wav.durations(F.col("audio")).alias("duration_ms"))


@query(
    """
with s as (select conv_id, floor(8000 * least(3.0, greatest(1.0, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10ffff}]', '', 'g'))) * 0.01::double)))::bigint as samples
  from conversations where trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '')
select conv_id, 44 + 2 * sum(samples)::bigint as n_bytes, floor(sum(samples) * 2 / 16000 * 1000 + 0.5)::bigint as duration_ms from s group by 1"""
)
def audio_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as one file of test audio."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text")
    whole = wav.export(wav.with_audio(turns, "text")).where("audio IS NOT NULL")
    return whole.select(F.col("doc_id").alias("conv_id"), F.octet_length("audio").cast("long").alias("n_bytes"), wav.durations(F.col("audio")).alias("duration_ms"))


@query(
    """
with t as (select conv_id, turn, coalesce(role, '') as role, length(coalesce(text, '')) as n from conversations),
l as (select conv_id as doc_id, turn, case role when 'system' then 16.0 else 10.0 end as h, 'w' || turn || ' of ' || role || ' ' || n as text, 100 + turn * 60 as y from t),
k as (select doc_id, turn, h, text, y, row_number() over (partition by doc_id order by turn) - 1 as place from l),
b as (select doc_id, arg_min(h, (-c, p)) as body from (select doc_id, h, count(*) as c, min(place) as p from k group by 1, 2) group by 1),
x as (select doc_id, 0 as kind, turn, text, case when h > body * 1.15 then 'heading' when h < body * 0.8 then 'footnote' else 'paragraph' end as type, case when h > body * 1.15 then case when h > body * 1.45 then 1 else 2 end end as level, y from k join b using (doc_id)),
f as (select distinct doc_id, 1 as kind, 999 as turn, 'pág. ' || doc_id % 97 as text, 'page-number' as type, NULL::int as level, 980 as y from k)
select doc_id, row_number() over (partition by doc_id order by kind, turn) - 1 as ord, type, text, level, (y)::double as y0 from (from x union all from f)"""
)
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of three items each, slightly out of line, and a small page number at the foot."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    high = F.when(F.col("role") == "system", 16.0).otherwise(10.0)
    y = (100 + F.col("turn") * 60).cast("double")
    item = lambda s, x, wide, dy: F.struct(s.alias("str"), F.lit(x).alias("x"), F.lit(wide).alias("width"), (y + dy).alias("y_top"), high.alias("height"))
    parts = F.array(
        item(F.concat(F.lit("w"), F.col("turn").cast("string")), 50.0, 30.0, 0.0), item(F.concat(F.lit("of "), F.col("role")), 90.0, 40.0, 1.5), item(F.col("n").cast("string"), 140.0, 20.0, 0.5), item(F.lit(" "), 170.0, 5.0, 0.0)
    )
    items = turns.select("doc_id", "turn", F.posexplode(parts).alias("k", "i"))
    items = items.select("doc_id", F.struct("turn", "k").alias("place"), "i.*")
    foot = turns.select("doc_id").distinct().select(
        "doc_id", F.struct(F.lit(999).cast("long").alias("turn"), F.lit(0).alias("k")).alias("place"), F.concat(F.lit("pág. "), (F.col("doc_id") % 97).cast("string")).alias("str"),
        F.lit(300.0).alias("x"), F.lit(30.0).alias("width"), F.lit(980.0).alias("y_top"), F.lit(6.0).alias("height"),
    )
    from pyspark.sql import Window

    both = items.unionByName(foot).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).cast("long"))
    page = both.select("doc_id", F.lit(1).cast("long").alias("page"), F.lit(600.0).alias("page_width"), F.lit(1000.0).alias("page_height"), "seq", "str", "x", "y_top", "width", "height")
    out = layout.blocks(page)
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text", "level", F.get("box", F.lit(1)).alias("y0"))


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def _xml(text: str) -> str:
    return "".join(c for c in text if c >= " " or c in "\t").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def docx_file(title: str, lines: list[str]) -> bytes:
    """A small word-processor file: a heading, a paragraph a line, and a table of one row of heads and one of lengths."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t xml:space="preserve">{_xml(t)}</w:t></w:r></w:p>'
    row = lambda cells, head: f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if head else ''}{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr>"
    table_ = f"<w:tbl>{row(['Lines', 'Units'], True)}{row([str(len(lines)), str(sum(map(len, lines)))], False)}</w:tbl>"
    body = p(title, "Heading2") + "".join(p(x) for x in lines) + table_
    styles = f'<w:styles {ns}><w:style w:type="paragraph" w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>'
    return _archive({"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def epub_file(title: str, lines: list[str]) -> bytes:
    """A small book: a section with a heading, one with a paragraph a line, one out of line, and contents."""
    page = lambda body: f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>{body}</body></html>'
    nav = '<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>' + f'<li><a href="a%20b.xhtml">{_xml(title)}</a><ol><li><a href="c.xhtml#x">Lines</a></li></ol></li></ol></nav>'
    manifest = "".join(f'<item id="{i}" href="{h}" media-type="application/xhtml+xml"{more}/>' for i, h, more in (("a", "a%20b.xhtml", ""), ("c", "c.xhtml", ""), ("n", "n.xhtml", ' properties="nav"'), ("z", "z.xhtml", "")))
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:language>es</dc:language></metadata>'
        f'<manifest>{manifest}</manifest><spine><itemref idref="a"/><itemref idref="z" linear="no"/><itemref idref="c"/><itemref idref="gone"/></spine></package>'
    )
    return _archive({
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>',
        "OEBPS/p.opf": package, "OEBPS/n.xhtml": page(nav), "OEBPS/a b.xhtml": page(f"<h1>{_xml(title)}</h1>"), "OEBPS/z.xhtml": page("<p>aside</p>"),
        "OEBPS/c.xhtml": page("".join(f"<p>{_xml(x)}</p>" for x in lines)),
    })


def _files(df: DataFrame, make) -> DataFrame:
    @F.pandas_udf("binary")
    def build(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, texts in rows:
            yield pd.Series([make(f"Item number {i}", [x.strip() for x in (t or "").split("\n") if x.strip()]) for i, t in zip(ids, texts, strict=True)])

    return df.withColumn("content", build("doc_id", "text"))


_LINES = """
l as (select item_id as doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from benchmark),
k as (select doc_id, text, row_number() over (partition by doc_id order by i) as i from l where text <> ''),
s as (select b.item_id as doc_id, count(k.i) as n, coalesce(sum(length(k.text)), 0)::bigint as units from benchmark b left join k on k.doc_id = b.item_id group by 1)"""


@query(
    f"""
with {_LINES}
select doc_id, 0 as ord, 'heading' as type, 'Item number ' || doc_id as text, 2 as level from s union all
select doc_id, i, 'paragraph', text, NULL from k union all
select doc_id, n + c, 'table-cell', (['Lines', 'Units', n::varchar, units::varchar])[c], NULL from s, (select unnest([1, 2, 3, 4]) as c)"""
)
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as word-processor files, written and parsed."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return archives.docx_blocks(_files(items, docx_file)).select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text", "level")


@query(
    f"""
with {_LINES},
h as (select doc_id, min(i) as i from k where contains(lower(text), 'lines') group by 1)
select doc_id, 0 as ord, 'heading' as type, 'Item number ' || doc_id as text, 1 as page from s union all
select k.doc_id, k.i, case when k.i = h.i then 'heading' else 'paragraph' end, k.text, 3 from k left join h using (doc_id)"""
)
def epub_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as books of two linear sections, written and parsed."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return archives.epub_blocks(_files(items, epub_file)).select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text", "page")


@query("select item_id, 6::bigint as n_entries, NULL::varchar as problem from benchmark")
def book_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of the same books through the preflight."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    checked = formats.zip_preflight(archives.entries(_files(items, epub_file)), "doc_id")
    return checked.select(F.col("doc_id").alias("item_id"), "n_entries", "problem")


@query("select doc_id, doc_id % 5 as encoding, sha256(case when doc_id % 5 = 4 then regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f\\x{a0}-\\x{ff}]', '', 'g') || chr(233) else coalesce(text, '') end) as text_sha256 from documents")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in five encodings, told by their marks or by what is no UTF-8, and decoded."""
    k, said = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    western = F.concat(F.regexp_replace(said, r"[^\x00-\x7f\u00a0-\u00ff]", ""), F.lit("é"))
    raw = (
        F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(said, "UTF-16LE"))).when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(said, "UTF-16BE")))
        .when(k == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(said, "UTF-8"))).when(k == 3, F.encode(said, "UTF-8")).otherwise(F.encode(western, "ISO-8859-1"))
    )
    files = table(spark, sf_dir, "documents").select("doc_id", k.alias("encoding"), raw.alias("content"))
    return files.select("doc_id", "encoding", F.sha2(decoded(F.col("content")), 256).alias("text_sha256"))


_SAID = "regexp_replace(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g')"


def _said() -> Column:
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]+", " ")
    return F.regexp_replace(F.trim(plain), " +", " ")


def _made_blocks(parts: str) -> str:
    return f"""
with d as (select doc_id, {_SAID} as s from documents), e as (select doc_id, case when s = '' then 'leer' else s end as s from d),
b as (select doc_id, unnest([{parts}]) as b from e)
select doc_id, row_number() over (partition by doc_id order by b.i) - 1 as ord, b.type as type, b.text as text, b.level as level, b.list_level as list_level from b"""


def _part(i: int, kind: str, text: str, level: str = "NULL::int", depth: str = "NULL::int") -> str:
    return f"{{'i': {i}, 'type': '{kind}', 'text': {text}, 'level': {level}, 'list_level': {depth}}}"


@query(
    _made_blocks(", ".join([
        _part(1, "heading", "'T ' || s", "2"), _part(2, "paragraph", "'a & ' || s || ' b'"), _part(3, "list-item", "'one ' || s", depth="0"), _part(4, "list-item", "'two'", depth="1"), _part(5, "table-cell", "'H'"),
        _part(6, "table-cell", "s"), _part(7, "quote", "'q ' || s"), _part(8, "code", "'c ' || s"), _part(9, "paragraph", "'[Imagen: ' || s || ']'"), _part(10, "paragraph", "'end'"),
    ]))
)
def html_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages made of documents' beginnings, with markup that must not be spoken, and their blocks."""
    s = F.col("s")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(_said() == "", "leer").otherwise(_said()).alias("s"))
    page = F.concat(
        F.lit("<head><title>no</title></head><body><script>var no</script><h2>T "), s, F.lit("</h2><p>a &amp;\n <b>"), s, F.lit("</b> b<ul><li>one "), s, F.lit("<ul><li>two</ul></ul><table><tr><th>H<td>"), s,
        F.lit("</table><blockquote>q "), s, F.lit("</blockquote><pre>c "), s, F.lit("</pre><p><img alt=\""), s, F.lit("\"></p><button>no</button><div>end</div>"),
    )
    out = html.html_blocks(docs.select("doc_id", page.alias("content")))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text", "level", "list_level")


@query(
    _made_blocks(", ".join([
        _part(1, "heading", "'T ' || s", "3"), _part(2, "paragraph", "'a ' || s || ' b'"), _part(3, "list-item", "'one ' || s", depth="0"), _part(4, "list-item", "'two'", depth="1"), _part(5, "quote", "'q ' || s"),
        _part(6, "code", "'c ' || s"), _part(7, "separator", "''"), _part(8, "paragraph", "'H1 H2 x ' || s"), _part(9, "heading", "'End'", "1"),
    ]))
)
def markdown_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made of documents' beginnings and its blocks."""
    s = F.col("s")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(_said() == "", "leer").otherwise(_said()).alias("s"))
    source = F.concat(
        F.lit("### T "), s, F.lit(" ###\n\na **"), s, F.lit("** b\n\n- one "), s, F.lit("\n  - two\n\n> q "), s, F.lit("\n\n```x\nc "), s, F.lit("\n```\n\n---\n\n| H1 | H2 |\n|---|---|\n| x | "), s, F.lit(" |\n\nEnd\n===\n"),
    )
    out = markdown.markdown_blocks(docs.select("doc_id", source.alias("content")))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text", "level", "list_level")


def _document_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files: text, Markdown, one without an extension that begins like a page description, others."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.concat(F.lit("d"), (k % 10).cast("string"), F.lit("/"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".MD", "", ".bin"))), (k % 4 + 1).cast("int")))
    content = F.encode(F.concat(F.when(k % 8 == 2, "%PDF-").otherwise(""), F.coalesce("text", F.lit(""))), "UTF-8")
    place = fresh_folder(spark, "documents")
    folder.write_files(docs.select(name.alias("name"), content.alias("content")), place)
    return place


@query(
    """
with f as (select doc_id, case when doc_id % 8 = 2 then '%PDF-' else '' end || coalesce(text, '') as body from documents)
select 'd' || doc_id % 10 || '/' || doc_id || (['.txt', '.MD', '', '.bin'])[doc_id % 4 + 1] as name, case doc_id % 4 when 0 then 'txt' when 1 then 'markdown' else 'pdf' end as format,
  octet_length(encode(body)) as size, case when octet_length(encode(body)) = 0 then 'empty_file' when doc_id % 4 = 2 then 'unsupported_type' end as reject, sha256(body) as fingerprint
from f where (doc_id % 4 < 2 or doc_id % 8 = 2) and octet_length(encode(body)) >= 600"""
)
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as files and read by the data source: those of a known format of 600 bytes and more, by pushed filters."""
    found = folder.documents(spark, _document_files(spark, sf_dir)).where("format IS NOT NULL AND size >= 600")
    name = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
    return found.select(name.alias("name"), "format", "size", "reject", F.sha2("content", 256).alias("fingerprint"))
