"""Corpus folders against the files they are read from."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from plectrum.functions.text import fingerprint
from plectrum.operators import evaluation
from plectrum.sources import corpus

DATA = Path(__file__).parent / "data"


def test_documents_and_blocks(spark):
    paths = [f"file://{p}" for p in sorted(DATA.glob("*.json"))]
    want = [json.loads(p.read_text()) for p in sorted(DATA.glob("*.json"))]
    got = {r["doc_id"]: r for r in corpus.documents(spark, paths).collect()}
    assert {d["id"]: (d["source"]["name"], d["source"]["pageCount"]) for d in want} == {k: (r["name"], r["page_count"]) for k, r in got.items()}
    blocks = corpus.blocks(spark, paths).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["block_id"], r["type"], r["text"]) for r in blocks] == [(d["id"], b["id"], b["type"], b["text"]) for d in sorted(want, key=lambda d: d["id"]) for b in d["blocks"]]


def test_manifest_gold_and_pairs(spark, tmp_path):
    entries = [{"id": "a", "title": "A", "category": "c", "description": "d", "pdf": "/x.pdf", "reference": "/r.json", "gold": "/g.json", "synthetic": True}, {"id": "b", "title": "B", "category": "c", "description": "d", "pdf": "/y", "synthetic": False}]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "notice": "n", "entries": entries}, indent=1))
    listed = corpus.manifest(spark, f"file://{tmp_path}/m.json")
    assert [(r["place"], r["id"]) for r in listed.collect()] == [(0, "a"), (1, "b")] and [r["id"] for r in corpus.cohort(listed).collect()] == ["a"]
    (tmp_path / "g.json").write_text(json.dumps({"fixtureId": "f", "notice": "n", "entries": [{"blockId": "b1", "spokenText": "uno"}, {"blockId": "b0", "spokenText": "dos"}]}))
    gold = corpus.gold(spark, f"file://{tmp_path}/g.json")
    assert [(r["entry"], r["block_id"], r["gold_text"]) for r in gold.collect()] == [(0, "b1", "uno"), (1, "b0", "dos")]
    pairs = tmp_path / "golden"
    pairs.mkdir()
    for name, text in {"x.in.txt": " a\n", "x.expected.txt": "b", "y.in.txt": "c", "note.md": "z"}.items():
        (pairs / name).write_text(text)
    assert {tuple(r) for r in corpus.golden_pairs(spark, f"file://{pairs}").collect()} == {("x", "a", "b"), ("y", "c", None)}
    assert corpus.asset_path("/r/public/", "/corpus/x.json") == "/r/public/corpus/x.json"


def test_changed_files_are_not_reopened(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"three")], "path string, content binary")
    known = files.limit(2).select("path", F.when(F.col("path") == "a", fingerprint(F.col("content"))).otherwise("0" * 32).alias("fingerprint"))
    assert {r["path"]: r["same"] for r in corpus.verified(files, known).collect()} == {"a": True, "b": False, "c": False}


def test_gold_segments_take_the_first(spark):
    segments = spark.createDataFrame([(1, 1, "s1", "b0", "x"), (1, 0, "s0", "b0", "y")], "doc_id long, ord int, segment_id string, block_id string, spoken_text string")
    gold = spark.createDataFrame([(1, "b0", "g"), (1, "b9", "h")], "doc_id long, block_id string, gold_text string")
    assert [tuple(r) for r in evaluation.gold_segments(gold, segments).collect()] == [(1, "b0", "g", "s0", "y")]
