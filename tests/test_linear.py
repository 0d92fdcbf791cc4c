"""Packing, splitting, line grouping and needle lookup against plain versions, and their work on very large documents."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plectrum.operators import chunks, lookup, navigation
from plectrum.sources import layout

PARTS = "doc_id long, ord int, part int, segment_id string, piece string"


def plain_pack(pieces, limit, least):
    done = []
    for segment, text in pieces:
        if done and (not done[-1][0] or len(done[-1][0]) + len(text) + 1 <= limit):
            done[-1] = (done[-1][0] + " " + text, done[-1][1] + [segment])
        else:
            done.append((text, [segment]))
    done, out = [(t.strip(), i) for t, i in done if t.strip()], []
    for text, ids in done:
        if least > 1 and out and (len(out[-1][0]) < least or len(text) < least) and len(out[-1][0]) + 1 + len(text) <= limit:
            out[-1] = (out[-1][0] + " " + text, out[-1][1] + ids)
        else:
            out.append((text, ids))
    return out


@pytest.mark.parametrize(("limit", "least"), [(40, 0), (40, 12), (40, 30), (10, 200), (2, 2)])
def test_pack(spark, limit, least):
    rng = random.Random(limit + least)
    rows = [(d, i, p, f"s{i}", "x" * rng.choice([0, 1, 2, 5, 9, 20, 38, 60])) for d in range(40) for i in range(rng.randrange(12)) for p in range(rng.randrange(1, 3))]
    rng.shuffle(rows)
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents run across batches
    for r in chunks.pack(spark.createDataFrame(rows, PARTS).repartition(3), limit, least).orderBy("doc_id", "chunk").collect():
        assert r["chunk"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append((r["text"], r["segment_ids"]))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {d: plain_pack([(r[3], r[4]) for r in sorted(rows) if r[0] == d], limit, least) for d in {r[0] for r in rows}}
    assert got == {d: c for d, c in want.items() if c}
    assert chunks.pack(spark.createDataFrame([], PARTS), limit, least).count() == 0


def test_a_document_of_many_segments_is_packed_in_linear_time(spark):
    def took(n):
        parts = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.lit(0).alias("part"), F.concat(F.lit("s"), "id").alias("segment_id"), F.lit("some words of a segment").alias("piece"))
        began = time.time()
        assert chunks.pack(parts, 400, 100).agg(F.sum(F.size("segment_ids"))).first()[0] == n
        return time.time() - began

    took(1000)
    assert took(200_000) < 12


def plain_split(text, limit):
    """Code units of the basic plane only."""
    out, rest = [], text
    while len(rest) > limit:
        window = rest[:limit]
        hits = [m.start() + 2 for m in re.finditer(r"[.!?…]\s+\S", window)] or [m.start() + 2 for m in re.finditer(r",\s+\S", window)]
        end = hits[-1] if hits else (window.rfind(" ") + 1 if " " in window else limit)
        out.append(rest[:end].strip())
        rest = rest[end:].lstrip()
    return [p for p in [*out, rest] if p]


def test_split_long():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["a", "bb", " ", ". ", ", ", "\n", "!", "é", "… "]) for _ in range(rng.randrange(120)))
        for limit in (2, 7, 30):
            assert chunks.split_long(text, limit) == plain_split(text, limit)
    assert chunks.split_long("🙂" * 5, 3) == ["🙂"] * 5
    for text in ("x" * 10_000_000, "word " * 2_000_000, "One. " * 2_000_000):
        began = time.time()
        assert sum(len(p) for p in chunks.split_long(text, 400)) > 0.7 * len(text)
        assert time.time() - began < 8


def test_lines_of_pages_across_batches(spark):
    rng = random.Random(6)
    rows = [(d, p, 600.0, 800.0, i, f"w{i}", float(rng.randrange(500)), rng.random() * 60, 5.0, rng.choice([4.0, 8.0, 10.0])) for d in range(3) for p in range(4) for i in range(25)]
    schema = "doc_id long, page long, page_width double, page_height double, seq long, str string, x double, y_top double, width double, height double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    got = {(r["doc_id"], r["page"], r["y"]) for r in layout.lines(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for d in range(3):
        for p in range(4):
            anchor = None
            for r in sorted((r for r in rows if r[:2] == (d, p)), key=lambda r: (r[7], r[6], r[4])):
                if anchor is None or abs(r[7] - anchor) > max(r[9] * 0.5, 2):
                    anchor = r[7]
                    want.add((d, p, anchor))
    assert got == want


def test_first_holding(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("ab é", k=n))
    texts = [(d, p, text(rng.randrange(80))) for d in range(6) for p in range(9)] + [(1, 50, None), (7, 0, "only text"), (None, 0, "abc")]
    needles = [(d, k, text(rng.choice([1, 2, 5, 8, 9, 14]))) for d in range(6) for k in range(25)] + [(1, 90, ""), (1, 91, None), (8, 0, "x"), (2, 92, "ab" * 30)]
    for d, _, t in [x for x in texts if x[2] and len(x[2]) > 30][:8]:
        needles.append((d, 100 + len(needles), t[3:33]))
    df = lambda rows, s: spark.createDataFrame(rows, s).repartition(3)
    got = {(r["doc_id"], r["key"]): r["place"] for r in lookup.first_holding(df(needles, "doc_id long, key long, needle string"), df(texts, "doc_id long, place long, text string")).collect()}
    want = {}
    for d, k, n in needles:
        held = [p for e, p, t in texts if e == d and n and t is not None and n in t]
        if held:
            want[d, k] = min(held)
    assert got == want and len(want) > 60


def test_many_headings_of_one_document(spark):
    """Each chunk is read once, however many headings there are."""
    chunks_ = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("chunk"), F.concat(F.lit("Chapter number "), F.col("id"), F.lit(": "), F.repeat(F.lit("some words "), 40)).alias("text"))
    heads = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("ord"), F.concat(F.lit("CHAPTER NUMBER "), F.col("id"), F.lit(":")).alias("text"))
    began = time.time()
    found = navigation.heading_chunks(heads, chunks_).where("ord = chunk").count()
    assert found == 3000 and time.time() - began < 30
