"""Streams in several batches against the same operators over whole tables."""

import random

import pytest

from plectrum import streaming
from plectrum.operators import serving

KIND = "user long, ms long, id long, epoch long, kind string"


@pytest.fixture(scope="module")
def log():
    rng, t, rows = random.Random(8), 0, []
    for i in range(240):
        t += rng.randrange(0, 9000)
        rows.append((rng.randrange(4), t, i, rng.randrange(1 + i // 40, 4 + i // 40), rng.choice("abc")))
    return rows


def streamed(spark, log, tmp_path, build, mode="append"):
    """The rows that a stream over the log, one file a batch, has put out."""
    folder = str(tmp_path / "in")
    for a in range(0, len(log), 80):
        spark.createDataFrame(log[a : a + 80], KIND).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
    name = build.__name__.strip("<>") + str(abs(hash(folder)))
    query = build(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    ended = query.awaitTermination(90)
    query.stop()
    assert ended
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name).collect()


def test_rate_limit(spark, log, tmp_path):
    def limited(df):
        return streaming.rate_limit(df.selectExpr("user", "ms / 1000 AS s", "id"), "user", "s", "id", 3, sweep_ms=None)

    got = {r["id"]: (r["window_start"], r["place"], r["allowed"], r["retry_after_s"]) for r in streamed(spark, log, tmp_path, limited)}
    table = spark.createDataFrame(log, KIND).selectExpr("user", "ms / 1000 AS s", "id")
    want = {r["id"]: (r["window_start"], r["place"], r["allowed"], r["retry_after_s"]) for r in serving.rate_limit(table, "user", "s", "id", 3).collect()}
    assert got == want and not all(w[2] for w in want.values())


def test_pacing(spark, log, tmp_path):
    def paced(df):
        return streaming.pacing(df.select("user", "ms", "id"), "user", "ms", "id", 5)

    got = {r["id"]: (r["start_ms"], r["wait_ms"]) for r in streamed(spark, log, tmp_path, paced)}
    want = {r["id"]: (r["start_ms"], r["wait_ms"]) for r in serving.pacing_starts(spark.createDataFrame(log, KIND), "user", "ms", "id", 5).collect()}
    assert got == want


def test_stale_results(spark, log, tmp_path):
    def current(df):
        return streaming.current_results(df, "user", "epoch", "ms")

    from pyspark.sql import functions as F

    got = sorted(r["id"] for r in streamed(spark, log, tmp_path, current))
    want = serving.current_epoch(spark.createDataFrame(log, KIND), "user", "epoch", F.struct("ms", "id")).where("kept")
    assert got == sorted(r["id"] for r in want.collect()) and len(got) < len(log)


def test_latest_positions(spark, log, tmp_path):
    def last(df):
        return streaming.latest(df, "user", "ms", "id", "kind")

    got = {r["user"]: (r["at"], r["id"]) for r in streamed(spark, log, tmp_path, last, "complete")}
    assert got == {u: max((r[1], r[2]) for r in log if r[0] == u) for u in {r[0] for r in log}}


def test_work_once_and_windows(spark, log, tmp_path):
    def once(df):
        return streaming.work_once(df.selectExpr("kind", "id", "timestamp_millis(ms) AS ts"), "kind", "ts", "1 day")

    got = streamed(spark, log, tmp_path, once)
    assert sorted(r["kind"] for r in got) == ["a", "b", "c"]

    def counted(df):
        return streaming.outcome_counts(df.selectExpr("kind", "timestamp_millis(ms) AS ts"), "ts", "kind", "1 minute", "0 seconds")

    (tmp_path / "two").mkdir()
    closed = streamed(spark, log, tmp_path / "two", counted)
    want = {}
    for r in log:
        want[r[1] // 60_000, r[4]] = want.get((r[1] // 60_000, r[4]), 0) + 1
    assert closed and all(want[int(r["start"].timestamp()) // 60, r["outcome"]] == r["n"] for r in closed)
