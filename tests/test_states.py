"""Keyed state with timers, the write-through cache and versioned tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from plectrum.session import fresh_folder
from plectrum.sinks.versions import Versions
from plectrum.streaming import replay, states
from plectrum.streaming.cache import WriteThrough

LOG = "user long, ms long, id long, kind string, batch long"
HOUR = 3_600_000


def run(rows, build, name):
    """What a stream emits over the batches, and the rows of state after each run."""
    held = []

    def start(source, checkpoint):
        sink = build(source).writeStream.format("parquet").option("path", checkpoint + "-out").option("checkpointLocation", checkpoint)
        query = sink.trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        held.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
        return query

    spark = rows.sparkSession
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder = replay.feed(rows, "batch", start, name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.parquet(folder + "/checkpoint-out").collect(), held


def test_windows_count_late_rows_and_go_with_the_watermark(spark):
    rows = [(1, 1000, 0, "a", 0), (1, 2000, 1, "a", 0), (None, 2500, 2, "a", 0), (1, HOUR, 3, "a", 1), (1, 3000, 4, "a", 1), (1, HOUR + 10 * HOUR, 5, "a", 2), (1, HOUR - 1, 6, "late", 3), (2, 11 * HOUR + 5, 7, "b", 3)]
    df = spark.createDataFrame(rows, LOG)
    got, held = run(df, lambda s: states.rate_limit(s, "user", "ms", "id", 2, 60_000, "2 hours"), "windows")
    told = {r["id"]: (r["window_start"], r["place"], r["allowed"], r["retry_after_s"]) for r in got}
    assert told == {0: (0, 1, True, 0), 1: (0, 2, True, 0), 2: (0, 1, True, 0), 3: (3600, 1, True, 0), 4: (0, 3, False, 57), 5: (39600, 1, True, 0), 7: (39600, 1, True, 0)}
    assert held[1] > held[0] > 0 and held[2] < held[1]  # after the jump of ten hours the windows before it are gone


def test_saved_values_expire_once(spark):
    rows = [(1, HOUR, 0, "a", 0), (2, HOUR, 1, "b", 0), (1, 3 * HOUR, 2, "c", 1), (1, 2 * HOUR + 1, 3, "older", 1), (3, 30 * HOUR, 4, "d", 2), (1, 40 * HOUR, 5, "again", 3)]
    got, held = run(spark.createDataFrame(rows, LOG), lambda s: states.latest(s, "user", "ms", "id", "kind", ttl_ms=5 * HOUR, late="1 hour", kind="state"), "saved")
    assert sorted(map(tuple, got)) == [(1, HOUR, "a", "saved"), (1, 3 * HOUR, "c", "expired"), (1, 3 * HOUR, "c", "saved"), (1, 40 * HOUR, "again", "saved"), (2, HOUR, "b", "expired"), (2, HOUR, "b", "saved"), (3, 30 * HOUR, "d", "expired"), (3, 30 * HOUR, "d", "saved")]
    assert held[-1] < held[0]


def test_lists_are_bounded(spark):
    rng = random.Random(4)
    rows = [(i % 3, i * 1000, i, rng.choice("abcdefgh"), i // 40) for i in range(160)]
    df = spark.createDataFrame(rows, LOG)
    got, _ = run(df, lambda s: states.recents(s, "user", "ms", "id", "kind", 4), "recent")
    for batch in range(4):
        for user in range(3):
            last = {}
            for r in rows:
                if r[0] == user and r[4] <= batch:
                    last[r[3]] = r[1]
            want = sorted(((at, k) for k, at in last.items()), reverse=True)[:4]
            assert all((user, p, k, at) in {tuple(r) for r in got} for p, (at, k) in enumerate(want, 1))
    got, held = run(df, lambda s: states.ring(s, "user", "ms", "id", 5), "ring")
    assert sorted(tuple(r) for r in got) == sorted((u, 5, own[-5], own[-1]) for u in range(3) for b in range(4) for own in [[r[2] for r in rows if r[0] == u and r[4] <= b]])


def test_epochs_are_forgotten_when_idle(spark):
    rows = [(1, HOUR, 5, "a", 0), (1, HOUR + 1, 3, "stale", 0), (1, HOUR + 2, 6, "b", 1), (2, 30 * HOUR, 1, "c", 2), (1, 31 * HOUR, 2, "new life", 3), (1, 31 * HOUR + 1, 1, "stale", 3)]
    got, _ = run(spark.createDataFrame(rows, LOG).withColumn("n", F.col("id")), lambda s: states.current_results(s, "user", "ms", "n", "id", 5 * HOUR, "1 hour"), "epochs")
    assert sorted(r["kind"] for r in got) == ["a", "b", "c", "new life"]


MANY = [(None, 1000, 2**60 + 9999, None)] + [(2**60 + i, 1000 + i % 7, 2**60 + i, "x") for i in range(1500)]


def many(spark):
    """1501 keys in two batches, one of them missing, with numbers that doubles do not hold."""
    rows = [(u, ms + b, e, k, b) for b in (0, 1) for u, ms, e, k in MANY]
    return spark.createDataFrame(rows, LOG)


def test_keys_share_windows(spark):
    got, held = run(many(spark), lambda s: states.rate_limit(s, "user", "ms", "id", 1, 60_000, "2 hours"), "many-windows")
    assert {(r["user"], r["ms"], r["id"], r["kind"], r["place"], r["allowed"]) for r in got} == {(u, ms + b, e, k, b + 1, b == 0) for b in (0, 1) for u, ms, e, k in MANY}
    assert len(got) == 2 * len(MANY) and held == [held[0]] * 2 and held[0] <= states.BUCKETS  # one look at the state serves the keys of a bucket


def test_state_lies_in_two_partitions_a_core_however_many_are_asked_for(spark):
    rows = spark.createDataFrame([(u, 1000 + b, u, "a", b) for b in (0, 1) for u in range(40)], LOG)
    with replay.settings(spark, {"spark.sql.shuffle.partitions": "40"}):
        out = replay.replayed(rows, "batch", lambda s: states.ring(s, "user", "ms", "id", 5), "width")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    folder = Path(out.inputFiles()[0].removeprefix("file://")).parents[1]
    stores = [p for p in (folder / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == 2 * spark.sparkContext.defaultParallelism == 8
    assert sorted((r["user"], r["n"]) for r in out.collect()) == [(u, n) for u in range(40) for n in (1, 2)]


def test_an_empty_log_gives_no_rows(spark):
    df = spark.createDataFrame([], LOG)
    assert replay.replayed(df, "batch", lambda s: states.rate_limit(s, "user", "ms", "id", 2), "none").count() == 0


ROWS = StructType().add("id", LongType()).add("ms", LongType()).add("content", StringType())
AUDIO = StructType().add("audio", StringType())


def cache(spark, make=None, ttl_ms=None):
    made = []

    def counted(keys):
        made.append(sorted(r[0] for r in keys.collect()))
        return (make or (lambda k: k.withColumn("audio", F.upper("content"))))(keys)

    return WriteThrough(spark, fresh_folder(spark, "cache"), ROWS, "content", "ms", "id", counted, AUDIO, ttl_ms), made


def outcomes(c):
    return {r["id"]: (r["audio"], r["outcome"]) for r in c.answers().collect()}


def test_cache_makes_once_and_a_batch_handed_over_again_writes_nothing(spark):
    c, made = cache(spark)
    first, second = spark.createDataFrame([(1, 10, "x"), (2, 11, "x"), (3, 12, None)], ROWS), spark.createDataFrame([(4, 20, "x"), (5, 21, "y")], ROWS)
    c(first, 0)
    c(first, 0)
    c(second, 1)
    want = {1: ("X", "generated"), 2: ("X", "joined"), 3: (None, "provider_error"), 4: ("X", "cache_hit"), 5: ("Y", "generated")}
    assert outcomes(c) == want and made == [["x"], ["y"]]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(c.folder + "/answers/batch=1")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    c(second, 1)  # its entries are in the ledger: read back, not made again
    assert outcomes(c) == want and c.entries().count() == 2


def test_expired_entries_are_made_again(spark):
    c, made = cache(spark, ttl_ms=100)
    for i, ms in enumerate((0, 100, 101, 150)):
        c(spark.createDataFrame([(i, ms, "x")], ROWS), i)
    assert [o for _, (_, o) in sorted(outcomes(c).items())] == ["generated", "cache_hit", "generated", "cache_hit"]


def test_a_failed_write_does_not_fail_the_answer(spark, monkeypatch):
    c, _ = cache(spark)
    monkeypatch.setattr(c, "_save", lambda fresh, batch: None)
    c(spark.createDataFrame([(1, 10, "x"), (2, 11, "x")], ROWS), 0)
    assert outcomes(c) == {1: ("X", "cache_write_failed"), 2: ("X", "joined")}
    monkeypatch.undo()
    c(spark.createDataFrame([(3, 20, "x")], ROWS), 1)
    assert outcomes(c)[3] == ("X", "generated")
    broken, _ = cache(spark)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(broken.folder + "/entries")
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jvm, True).close()  # a file where the folder should be
    assert broken._save(spark.createDataFrame([("x", 1, "X")], "content string, saved_ms long, audio string"), 0) is None


SAVED = StructType().add("k", LongType()).add("at", LongType()).add("v", StringType())


def test_versions_touch_the_changed_buckets_alone(spark):
    t = Versions(spark, fresh_folder(spark, "t"), SAVED, "k", F.col("at"), 8)
    assert t.current() == 0 and t.read().count() == 0 and t.save(spark.createDataFrame([], SAVED)) == 0
    assert t.save(spark.createDataFrame([(i, 1, "a") for i in range(100)] + [(None, 1, "null")], SAVED)) == 1
    pinned = t.read()
    assert t.save(spark.createDataFrame([(7, 2, "b"), (7, 3, "c"), (8, 0, "older")], SAVED)) == 2
    old, new = t.manifest(1), t.manifest(2)
    assert 1 <= sum(old[b] != new[b] for b in old) <= 2 and pinned.count() == 101
    assert {r["v"] for r in pinned.where("k = 7").collect()} == {"a"} and [tuple(r) for r in t.get(7, 8).orderBy("k").collect()] == [(7, 3, "c"), (8, 1, "a")]
    assert t.save(spark.createDataFrame([(9, 1, "same time, later save")], SAVED)) == 3 and t.get(9).first()["v"] == "same time, later save"
    assert t.remove(spark.createDataFrame([(i,) for i in range(50)], "k long")) == 4 and t.read().count() == 51 and t.read(3).count() == 101
    assert t.vacuum(1) > 0 and t.versions() == [4] and t.read().count() == 51


def test_a_writer_that_comes_second_starts_again(spark):
    t = Versions(spark, fresh_folder(spark, "t"), SAVED, "k", F.col("at"), 4)
    t.save(spark.createDataFrame([(1, 1, "a")], SAVED))
    publish, between = t._publish, []

    def late(version, manifest):
        if not between:
            between.append(1)
            Versions(spark, t.folder, SAVED, "k", F.col("at"), 4).save(spark.createDataFrame([(1, 5, "other"), (2, 5, "other")], SAVED))
        return publish(version, manifest)

    t._publish = late
    assert t.save(spark.createDataFrame([(1, 3, "mine"), (3, 3, "mine")], SAVED)) == 3
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "other", 2: "other", 3: "mine"}
    t._publish = lambda version, manifest: False
    with pytest.raises(RuntimeError):
        t.save(spark.createDataFrame([(1, 9, "x")], SAVED), tries=2)
