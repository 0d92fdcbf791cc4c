"""The data source for folders of documents: what it lists, which filters it takes, how it deals files, and its stream."""

import os
import re

import pytest
from pyspark.sql import functions as F

from plectrum.sources import folder, formats, text


@pytest.fixture()
def place(tmp_path):
    files = {"a.txt": b"one\n\ntwo", "sub/b.MD": b"# head", "sub/deep/c.html": b"<p>x</p>", "scan": b"%PDF-1.4 rest", "odd.bin": b"bytes", "empty.txt": b"", "_hidden.txt": b"x", ".git/d.txt": b"x", "big.txt": b"z" * 5000}
    for name, data in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "in")


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_files_formats_and_refusals(spark, place):
    got = {r["name"]: r for r in folder.documents(spark, place).collect()}
    assert {n: (r["format"], r["size"], r["reject"]) for n, r in got.items()} == {
        "a.txt": ("txt", 8, None), "b.MD": ("markdown", 6, None), "c.html": ("html", 8, None), "scan": ("pdf", 13, "unsupported_type"),
        "odd.bin": (None, 5, "unsupported_type"), "empty.txt": ("txt", 0, "empty_file"), "big.txt": ("txt", 5000, None),
    }
    assert bytes(got["b.MD"]["content"]) == b"# head" and got["a.txt"]["modified_ms"] > 0
    assert "content" not in folder.documents(spark, place, content="false").columns and folder.documents(spark, place, content="false").count() == 7
    assert folder.documents(spark, place + "/none").count() == 0


def test_filters_are_taken_by_the_source(spark, place):
    docs = folder.documents(spark, "file://" + place)
    cases = {
        "format = 'txt' AND size > 0": ["a.txt", "big.txt"], "format = 'pdf'": ["scan"], "format IN ('html', 'markdown')": ["b.MD", "c.html"], "format IS NULL": ["odd.bin"],
        "size < 9 AND size >= 6 AND format IS NOT NULL": ["a.txt", "b.MD", "c.html"], "name LIKE 'b%'": ["b.MD", "big.txt"], "path LIKE '%deep%'": ["c.html"],
        "format = 'txt' OR size = 5": ["a.txt", "big.txt", "empty.txt", "odd.bin"], "length(name) = 4 AND size < 10": ["b.MD"], "format <=> NULL": ["odd.bin"],
    }
    for condition, want in cases.items():
        assert names(docs.where(condition)) == want, condition
    assert docs.count() == 7  # the filters of one query do not stay
    nodes = lambda df: re.findall(r"(\w+) ", re.sub(r"[*(1)+\-]", "", df._jdf.queryExecution().executedPlan().toString()))
    assert "Filter" not in nodes(docs.where("format = 'txt' AND size > 100")) and "Filter" in nodes(docs.where("modified_ms > 100"))


def test_excluded_files_are_not_opened(spark, place):
    os.chmod(f"{place}/big.txt", 0)
    os.rename(f"{place}/big.txt", f"{place}/gone.txt")
    reader = folder.FolderReader({"path": place})
    left = list(reader.pushFilters([folder.api.LessThan(("size",), 100), folder.api.EqualTo(("format",), "txt"), folder.api.EqualTo(("modified_ms",), 1)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [t.column for t in reader.files.tests] == ["size", "format"]
    assert [f.name for p in reader.partitions() for f in p.files] == ["a.txt", "empty.txt", "odd.bin", "scan"]  # the last two hang on their first bytes
    assert [n for b in reader.read(reader.partitions()[0]) for n in b.column("name").to_pylist()] == ["a.txt", "empty.txt"]


def test_files_are_dealt_by_size(spark, place):
    files = [folder.File(f"/{i}", n, 0) for i, n in enumerate([5, 5, 20, 1, 1, 1, 9])]
    assert [[f.size for f in p.files] for p in folder.dealt(files, 10)] == [[5, 5], [20], [1, 1, 1], [9]] and folder.dealt([], 10) == []
    assert folder.documents(spark, place, partitionBytes="10").rdd.getNumPartitions() == 6


def test_blocks_of_all_formats_by_their_adapters(spark, place):
    formats.register_adapter("txt", lambda df: text.text_blocks(df.select("doc_id", text.decoded(F.col("content")).alias("text"))))
    got = {(r["doc_id"].rsplit("/", 1)[1], r["text"]) for r in folder.document_blocks(spark, place).select("doc_id", "text").collect()}
    assert {("a.txt", "one"), ("a.txt", "two"), ("big.txt", "z" * 5000)} <= got and not any(n in ("scan", "odd.bin", "empty.txt") for n, _ in got)


def test_a_stream_takes_each_file_once(spark, place, tmp_path):
    folder.register(spark)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        source = spark.readStream.format(folder.NAME).option("settleMs", "0").load(place)
        query = source.select("name", F.length("content").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(once=True).start()
        assert query.awaitTermination(90)
        return sorted((r["name"], r["n"]) for r in spark.read.schema("name string, n int").parquet(out).collect())

    first = run()
    assert len(first) == 7
    with open(f"{place}/later.txt", "wb") as f:
        f.write(b"later")
    os.utime(f"{place}/later.txt", (2_000_000_000, 1_999_999_999))
    os.utime(f"{place}/later.txt", None)
    assert run() == sorted([*first, ("later.txt", 5)]) and run() == sorted([*first, ("later.txt", 5)])


def test_written_files_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("x/a.txt", bytearray(b"1")), ("b.txt", None), ("x/a.txt", bytearray(b"1"))], "name string, content binary")
    assert folder.write_files(df, f"file://{tmp_path}/o") == 3
    assert {r["name"]: bytes(r["content"]) for r in folder.documents(spark, f"{tmp_path}/o").collect()} == {"a.txt": b"1", "b.txt": b""}
