"""The automaton against plain counting, the cut documents against a brute-force version, and back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, odd_rows

from plectrum.llm import fill_middle as f


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or re.search("<[PSM]>", text):
        return (n, "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text))


def odd_texts():
    rng = random.Random(2)
    parts = ["\n", "\n\n", "<", "<P", "P>", "<S>", ">", "word", "é", "🙂", "\r", " ", "<M", "S", "M"]
    return ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(300)] + ["<<P>", "<P<S<M", "<P\n>", "a<", ">b", "\n", "x"]


def test_functions_compose_at_any_cut():
    a = f.Automaton()
    assert a.states == 6
    rng = random.Random(3)
    for text in odd_texts():
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(4)))
        pieces = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True) if i < j]
        functions = []
        for piece in pieces:
            symbols, _, sizes = a.symbols([piece])
            functions.append(f.Trees(*a.functions(symbols), sizes).whole(0))
        if not pieces:
            continue
        tree = f.Trees(np.array([e for e, _ in functions]), np.array([c for _, c in functions]), np.array([len(pieces)]))
        n, marked = f._outcome(a, *tree.whole(0))
        ends = [m.end() for m in re.finditer("\n", text)]
        assert (n, marked) == (len(re.findall(r"[^\n]*\n|[^\n]+", text)), bool(re.search("<[PSM]>", text)))
        for k, end in enumerate(ends, 1):
            i, state, wanted = tree.select(0, a.start, k)
            symbols, at, sizes = a.symbols([pieces[i]])
            leaf, _, _ = f.Trees(*a.functions(symbols), sizes).select(0, state, wanted)
            assert sum(map(len, pieces[:i])) + at[leaf] + 1 == end


@pytest.mark.parametrize("giant", [1 << 16, 20])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, giant):
    monkeypatch.setattr(f, "GIANT", giant)
    rng = random.Random(4)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*odd_texts(), *(r[1] for r in odd_rows())])]
    rows += [(None, "a\nb", "en", "s", 1), (-5, "a\nb\nc", "en", "s", 1), (-5, "a\nb\nc", "en", "s", 1), (-6, None, "en", "s", 1)]
    for i in range(6):
        rows.append((10_000 + i, "".join(rng.choice(["line\n", "longer line 🙂 ", "<P", "é\n"]) for _ in range(30_000)), "en", "hot", 1))
    rows.append((10_010, "x" * 200_000, "en", "s", 1))
    rows.append((10_011, "\n" * 100_000, "en", "s", 1))
    rows.append((10_012, "y\n" * 40_000 + "<P>", "en", "s", 1))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in f.query(spark, str(tmp_path)).collect())))
    assert got == sorted(str((r[0], *brute(r[0], r[1]))) for r in rows)


def test_markers_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(f, "GIANT", 10)
    edge = f.STRETCH
    for text in ("a" * (edge - 2) + "<P>" + "b\n", "a" * (edge - 1) + "<S>\n", "a" * (edge - 1) + "\nb", "🙂" * (edge - 1) + "\n" + "b\nc"):
        (r,) = f.fill_in_middle(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], sha(r["output"])) == brute(3, text)[:5]


def test_columns_of_any_name_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 2, "x", "dot", 9)], "doc_id long, text string, form int, `_text` string, `a.b` string, `_g` int")
    got = f.fill_in_middle(df)
    assert got.columns == [*df.columns, "_n_units", "_form", "_prefix_chars", "_middle_chars", "_output"]
    assert tuple(got.collect()[0])[:6] == (1, "a\nb\nc", 2, "x", "dot", 9)
    assert f.fill_in_middle(df.limit(0)).count() == 0
    some = f.fill_in_middle(spark.range(400).select("id", F.lit("a\nb\nc").alias("t")), key="id", text="t", percent=30, spm_percent=0)
    forms = {r["form"]: r["count"] for r in some.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 80 < forms["psm"] < 160
