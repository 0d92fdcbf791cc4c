"""The evaluation and serving metrics that no query reaches, on small tables with known results."""

import pytest

from plectrum.operators import metrics, serving


def test_extraction_metrics(spark):
    block = "doc_id long, ord int, type string, text string, page int"
    reference = spark.createDataFrame([(1, 0, "h", "a", 1), (1, 1, "p", "b", 1), (1, 2, "p", "c", 2), (2, 0, "p", "d", 1)], block)
    extracted = spark.createDataFrame([(1, 0, "p", "a", 1), (1, 1, "p", "b", 2)], block)
    matches = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 0.75)], "doc_id long, ref long, got long, dice double")
    got = {r["doc_id"]: tuple(r)[1:] for r in metrics.extraction_metrics(reference, extracted, matches).collect()}
    assert got == {1: (3, 2, 0.667, 0.875, 0.5, 1, 1), 2: (1, 0, 0.0, None, None, 0, 1)}


def test_chrome_recovered(spark):
    rows = "doc_id long, text string"
    reference = spark.createDataFrame([(1, "Footer"), (1, "Header"), (2, "Footer")], rows)
    extracted = spark.createDataFrame([(1, "Footer"), (1, "Footer"), (2, "Header")], rows)
    assert [tuple(r) for r in metrics.chrome_recovered(reference, extracted).collect()] == [(1, "Footer")]


def test_gold_agreement(spark):
    gold = spark.createDataFrame([(1, 0, "one two"), (1, 1, "one two three four"), (2, 9, "x")], "doc_id long, block_id long, gold_text string")
    spoken = spark.createDataFrame([(1, 0, "one two"), (1, 1, "one two five six")], "doc_id long, block_id long, spoken_text string")
    assert [tuple(r) for r in metrics.gold_agreement(gold, spoken).collect()] == [(1, 2, 0.75, 1)]


def test_rule_coverage(spark):
    rows = [(1, [("a",), ("b",)]), (1, [("a",)]), (2, [("c",)])]
    segments = spark.createDataFrame(rows, "doc_id long, transformations array<struct<rule:string>>")
    got = {r["doc_id"]: (r["fired"], r["share"]) for r in metrics.rule_coverage(segments, 21).collect()}
    assert got == {1: (2, pytest.approx(0.095)), 2: (1, pytest.approx(0.048))}


def test_request_metrics(spark):
    rows = [(7, 2, 150, 190, 503), (7, 1, 0, 100, 429), (7, 3, 400, 450, 200), (8, 1, 5, 9, 200)]
    attempts = spark.createDataFrame(rows, "request_id long, attempt int, start_ms long, end_ms long, status int")
    got = {r["request_id"]: r for r in serving.request_metrics(attempts).collect()}
    assert [tuple(g) for g in got[7]["gaps"]] == [(1, None), (2, 50), (3, 210)]
    assert tuple(got[7])[1:3] + tuple(got[7])[4:] == (3, 2, 1, 1, 0, 450)
    assert tuple(got[8])[1:3] + tuple(got[8])[4:] == (1, 0, 0, 0, 5, 9)
