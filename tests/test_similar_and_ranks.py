"""The similarity join and distributed ranks against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plectrum.operators import evaluation, metrics, ranks, similar


def words(text):
    return Counter(re.findall(r"[^\W_]+", (text or "").lower()))


def dice(a, b):
    x, y = words(a), words(b)
    return 2 * sum((x & y).values()) / (x.total() + y.total()) if x.total() + y.total() else 1.0


def texts(n, seed):
    rng = random.Random(seed)
    rare, often = [f"w{i}" for i in range(400)], ["the", "of", "and", "a"]
    out = []
    for i in range(n):
        own = [rng.choice(often) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.randrange(1, 30))]
        if out and i % 3 == 0 and out[-1][1]:
            own = out[-1][1].split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(rare)
        out.append((i, " ".join(own)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "THE the The"), (n + 3, "the the"), (n + 4, "--"), (n + 5, " ".join(["the"] * 300 + ["x"]))]


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8, 1.0])
def test_similar_pairs(spark, least):
    a, b = texts(80, 1), texts(90, 1) + [(500, "the the the")]
    df = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {(r["left_id"], r["right_id"]): r["dice"] for r in similar.similar_pairs(df(a), df(b), least).collect()}
    want = {(i, j): dice(x, y) for i, x in a for j, y in b if words(x) and words(y) and dice(x, y) >= least}
    assert got == pytest.approx(want) and len(want) > 20
    assert similar.similar_pairs(df(a).limit(0), df(b), least).count() == 0


def test_numbered_words(spark):
    got = spark.createDataFrame([("b a B  a a",), (None,), ("",), ("é-É 1",)], "t string").select(similar.numbered_words(F.col("t")).alias("w")).collect()
    assert [[w.replace("\x01", "#") for w in r["w"]] for r in got] == [["a#1", "a#2", "a#3", "b#1", "b#2"], [], [], ["1#1", "é#1", "é#2"]]


def test_frequent_words_hardly_meet(spark):
    """A tenth of what texts of a size within reach that share a word would make, and less."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "of", "and", "to", "in"], k=15) + [f"r{rng.randrange(3000)}" for _ in range(15)])) for i in range(300)]
    df = similar.records(spark.createDataFrame(rows, "id long, text string"))
    met = similar.meetings(df, df, 0.6).count()
    shared = sum(len(set(words(x)) & set(words(y))) for _, x in rows for _, y in rows)
    assert 300 <= met < shared / 10


def test_pairs_within_documents(spark):
    block = "doc_id long, ord int, type string, text string, page int"
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of"]
    ref = [(d, i, "paragraph", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 6))), 1) for d in range(6) for i in range(12)]
    got = [(d, i, "paragraph", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 6))), 1) for d in range(6) for i in range(10)]
    scored = evaluation.scored_pairs(spark.createDataFrame(ref, block), spark.createDataFrame(got, block))
    found = {(r["doc_id"], r["ref"]): (r["got"], r["dice"]) for r in metrics.greedy_match(scored).collect()}
    want = {}
    for d in range(6):
        used = set()
        for _, i, _, x, _ in sorted(r for r in ref if r[0] == d):
            free = [(-dice(x, y), j) for e, j, _, y, _ in got if e == d and j not in used and dice(x, y) >= 0.55]
            if free:
                s, j = min(free)
                used.add(j)
                want[d, i] = (j, -s)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()} and len(want) > 30


def test_percentiles_of_whole_tables(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1.0, 5.0, rng.random() * 100]), rng.randrange(10) if i % 3 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, y long, z long").repartition(4)
    ps = (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {(r["name"], r["p"]): r["value"] for r in ranks.percentiles(df, {"x": ps, "y": ps, "z": (0.5,)}).collect()}
    for k, name in enumerate("xyz"):
        own = sorted(r[k] for r in rows if r[k] is not None)
        for p in ps if name != "z" else (0.5,):
            assert got[name, p] == own[min(len(own) - 1, int(len(own) * p))]
    assert {(r["p"], r["z"]) for r in metrics.upper_percentiles(df, "z", (0.5,)).collect()} == {(0.5, 1500)}
    assert ranks.percentiles(df.limit(0), {"x": ps}).count() == 0 and ranks.percentiles(df.where("x IS NULL"), {"x": ps}).count() == 0


def test_ranks_need_no_window_without_a_key(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = ranks.percentiles(df, {"x": (0.5,)})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and all("key#" in line.split("], [")[1] for line in plan.split("\n") if "Window [" in line)


def test_stratified_sample_of_texts_with_copies(spark):
    rng = random.Random(9)
    pool = ["s" * rng.randrange(1, 119) + str(i) for i in range(40)] + ["m" * rng.randrange(130, 250) + str(i) for i in range(30)] + ["l" * rng.randrange(300, 400) + str(i) for i in range(3)]
    rows = [(i // 7, i % 7, rng.choice(pool)) for i in range(400)] + [(90, 0, None), (91, 0, "s")]
    got = metrics.stratified_sample(spark.createDataFrame(rows, "d long, o long, t string").repartition(4), "t", ["d", "o"], 20).collect()
    first = {}
    for d, o, t in sorted((r for r in rows if r[2] is not None)):
        first.setdefault(t, (d, o))
    for name, low, high, quota in (("short", 0, 119, 6), ("mid", 120, 260, 8), ("long", 261, 9999, 6)):
        own = sorted((p, t) for t, p in first.items() if low <= len(t) <= high)
        q = min(quota, len(own))
        assert sorted(((r["d"], r["o"]), r["t"]) for r in got if r["stratum"] == name) == [own[i * len(own) // q] for i in range(q)]
