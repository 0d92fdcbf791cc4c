import pytest

from plectrum.operators.chunks import plan_chunks, split_long
from plectrum.operators.plan import gold_plan, is_page_number, listen_plan, literal_plan, plan_stats, product_plan
from plectrum.sources import html, markdown
from plectrum.sources.text import decoded, text_blocks

BLOCKS = "doc_id long, ord int, type string, text string, page int, level int"


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [
        (1, 0, "heading", "Artículo 1. Objeto.", 1, None),
        (1, 1, "paragraph", "Deben 30 pb antes de 2024.", 1, None),
        (1, 2, "page-footer", "Pie de página", 1, None),
        (1, 3, "paragraph", "Documento oficial", 1, None),
        (1, 4, "paragraph", "Documento  oficial", 2, None),
        (1, 5, "paragraph", "documento oficial", 3, None),
        (1, 6, "paragraph", "sin cambios", 3, None),
    ]
    return spark.createDataFrame(rows, BLOCKS)


def test_listen_plan(blocks):
    plan = listen_plan(blocks).cache()
    by = {r["ord"]: r for r in plan.collect()}
    assert by[0]["spoken_text"] == "artículo uno. Objeto,"
    assert [t["rule"] for t in by[0]["transformations"]] == ["legal-references", "pause"]
    assert by[1]["spoken_text"] == "Deben treinta puntos básicos antes de dos mil veinticuatro."
    assert by[2]["muted_by"] == "layout-classification"
    assert [by[i]["muted_by"] for i in (3, 4, 5)] == ["repeat-detector"] * 3
    assert by[6]["segment_id"] == "s6" and by[6]["spoken_text"] == "sin cambios"
    stats = plan_stats(plan).first()
    assert (stats["blocks_total"], stats["segments"], stats["muted_noise"], stats["transformed"], stats["unchanged"], stats["rejected"]) == (7, 3, 4, 2, 1, 0)
    assert stats["rule_hits"] == {"legal-references": 1, "pause": 1, "basis-points": 1, "numbers": 1}
    chunks = plan_chunks(plan, 40).orderBy("chunk").collect()
    assert all(len(c["text"]) <= 40 for c in chunks)
    assert " ".join(c["text"] for c in chunks) == "artículo uno. Objeto, Deben treinta puntos básicos antes de dos mil veinticuatro. sin cambios"


def test_literal_and_gold_plans(spark, blocks):
    assert literal_plan(blocks).where("spoken_text = source_text AND NOT muted").count() == 7
    gold = spark.createDataFrame([(1, 0, "b1", "uno"), (1, 1, "missing", "x"), (1, 2, "b0", "cero")], "doc_id long, entry int, block_id string, gold_text string")
    own = blocks.selectExpr("doc_id", "concat('b', ord) AS block_id", "text", "page")
    assert [(r["segment_id"], r["gold_text"]) for r in gold_plan(gold, own).orderBy("entry").collect()] == [("g0", "uno"), ("g1", "cero")]


def test_product_plan_reads_tables_and_notes(spark):
    rows = [
        (1, 0, "paragraph", "Véase [1].", 1, None), (1, 1, "footnote", "1 Una nota", 1, None), (1, 2, "table-cell", "Plazo", 1, 0),
        (1, 3, "table-cell", "Tipo", 1, 1), (1, 4, "table-cell", "corto", 1, 0), (1, 5, "table-cell", "fijo", 1, 1), (1, 6, "page-number", "7", 1, None),
    ]
    out = {r["ord"]: r for r in product_plan(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert out[0]["spoken_text"] == "Véase [uno]. Nota uno: uno Una nota"
    assert out[2]["spoken_text"] == "Plazo: corto. Tipo: fijo"
    assert out[6]["muted"]


@pytest.mark.parametrize("text", ["x" * 1000, "a. b " * 300, "uno, dos " * 200, "🙂" * 700, " ", "a" * 400])
def test_long_texts_split_within_the_limit(text):
    parts = split_long(text, 400)
    assert all(0 < len(p.encode("utf-16-le", "surrogatepass")) <= 800 for p in parts)
    assert "".join(parts).replace(" ", "") == text.replace(" ", "")


def test_page_numbers(spark):
    rows = spark.createDataFrame([("12",), (" pág. 3 ",), ("3 de 10",), ("12345",), ("x 1",)], "t string")
    assert [r[0] for r in rows.select(is_page_number(rows["t"])).collect()] == [True, True, True, False, False]


def test_text_blocks_and_decoding(spark):
    docs = spark.createDataFrame([(1, "a \r\n b\n\n\nc"), (2, None), (3, "\n")], "doc_id long, text string")
    assert [(r["doc_id"], r["text"], r["source_ref"]) for r in text_blocks(docs).orderBy("doc_id", "ord").collect()] == [(1, "a b", "L1-L2"), (1, "c", "L5-L5")]
    raw = [("é".encode(),), ("é".encode("latin-1"),), (b"\xff\xfe" + "é".encode("utf-16-le"),), (b"\xef\xbb\xbf" + "é".encode(),), (b"\xfe\xff" + "é".encode("utf-16-be"),)]
    files = spark.createDataFrame([(bytearray(r[0]),) for r in raw], "content binary")
    assert {r[0] for r in files.select(decoded(files["content"])).collect()} == {"é"}


def test_html_blocks():
    page = "<nav>menu</nav><h1>T<b>i</b>t</h1><p>uno<p>dos <i>tres</i><br>x<ul><li>a<ul><li>b</ul><li>c</ul><script>no</script><img alt='foto'><table><tr><td>1<td>2</table>"
    strict = [(b["type"], b["text"]) for b in html.blocks(page)]
    assert strict == [
        ("paragraph", "menu"), ("heading", "Tit"), ("paragraph", "uno"), ("paragraph", "dos tres x"), ("list-item", "a"), ("list-item", "b"), ("list-item", "c"),
        ("paragraph", "[Imagen: foto]"), ("table-cell", "1"), ("table-cell", "2"),
    ]
    assert [b["text"] for b in html.blocks(page, "passthrough")][0] == "Tit"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert [b["text"] for b in html.blocks(deep)] == ["x"]


def test_markdown_blocks():
    page = "# Uno **dos**\n\ntexto `c*d*` [l](u)\nsigue\n\n- a\n  - b\n\n> cita\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n---\n\n```py\ncode\n```\n"
    assert [(b["type"], b["text"]) for b in markdown.blocks(page)] == [
        ("heading", "Uno dos"), ("paragraph", "texto c*d* l sigue"), ("list-item", "a"), ("list-item", "b"), ("quote", "cita"), ("paragraph", "x y 1 2"), ("separator", ""), ("code", "code"),
    ]


def test_a_reference_without_a_note_stays(spark):
    rows = [(1, 0, "paragraph", "Véase [2] y [1].", 1, None), (1, 1, "footnote", "1 uno", 1, None), (2, 0, "paragraph", "Sin [1] notas", 1, None)]
    out = {(r["doc_id"], r["ord"]): r["spoken_text"] for r in product_plan(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert out == {(1, 0): "Véase [dos] y [uno]. Nota uno: uno uno", (2, 0): "Sin [uno] notas"}


def test_a_choice_of_blocks_is_made_before_the_rules(spark):
    from pyspark.sql import functions as F

    rows = [("d", i, "paragraph", t, p) for i, (t, p) in enumerate([("Pie", 1), ("uno", 1), ("art. 5", 2), ("Pie", 2), ("Pie", 3), ("dos", 3)])]
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, page int")
    all_, some = listen_plan(blocks), listen_plan(blocks, only=~F.col("text").rlike("[0-9]"))
    assert sorted(map(str, some.collect())) == sorted(map(str, all_.where("NOT source_text RLIKE '[0-9]'").collect())) and some.where("muted").count() == 3


def test_literals_of_both_texts_stand_and_ordinals_need_not(spark):
    from pyspark.sql import functions as F

    from plectrum.functions.fidelity import contains_at_boundary, critical_tokens, standing

    t = "no deberá pagar 15 euros \U0001d54f salvo que 5ºx; xdeberá 1.500,5 y deberá"
    row = spark.range(1).select(critical_tokens(F.lit(t)).alias("c"), standing(critical_tokens(F.lit(t))).alias("s"), contains_at_boundary(F.lit("15"), F.lit("15")).alias("b")).first()
    places = {"no deberá": 0, "deberá": t.index("deberá"), "15": t.index("15"), "salvo que": t.index("salvo que") + 1, "5": t.index("5º") + 1, "5º": t.index("5º") + 1, "1.500,5": t.index("1.5") + 1}
    want = sorted([*((at, x) for x, at in places.items()), (t.rindex("deberá") + 1, "deberá")])  # one character of two units
    assert sorted((x["index"], x["text"]) for x in row["c"]) == want and "5º" not in row["s"] and len(row["s"]) == 7 and row["b"]
