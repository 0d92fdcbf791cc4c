"""Registered queries held to their DuckDB twins on small tables with large keys and odd sizes."""

import pytest

import __spark_entry__ as entry


def same_as_sql(spark, folder, name, tables):
    """The query's rows and the twin's, each row as strings, over tables (name to rows and schema)."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    own = entry.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in own.columns)
    wanted = con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in own.collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    return got


def test_chapters(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 else "assistant", "hola") for c in (1, 2) for t in range(12)]
    got = same_as_sql(spark, tmp_path, "chapters", {"conversations": (turns, "conv_id long, turn long, role string, text string")})
    assert sorted(got)[:3] == [(1, 1, 0), (1, 5, 1), (1, 9, 2)]


def test_file_formats_of_large_pages(spark, tmp_path):
    # 50,000 characters times 100,000 are more than 31 bits hold
    pages = [(i, "http://x", "x" * (50_000 if i == 8 else 10)) for i in range(60)]
    got = same_as_sql(spark, tmp_path, "file_formats", {"pages": (pages, "page_id long, url string, html string")})
    assert next(r for r in got if r[0] == 8)[2] == "file_too_large"


def test_page_number_lines_of_large_keys(spark, tmp_path):
    lines = [(i, k, i % 7 + 1, "ANR"[i % 3]) for i, k in enumerate([*range(30), *range(9_990, 10_020), *range(1_199_980, 1_200_000)])]
    schema = "l_orderkey long, l_partkey long, l_linenumber long, l_returnflag string"
    same_as_sql(spark, tmp_path, "page_number_lines", {"lineitem": (lines, schema)})


def test_greedy_match_takes_sorted_rows_and_no_group_at_a_time(spark):
    import random

    from plectrum.operators.metrics import greedy_match

    rng = random.Random(3)
    rows = [(d, r, g, rng.choice((0.5, 0.6, 0.6, 0.7, 0.9))) for d in (None, *range(40)) for r in range(6) for g in rng.sample(range(8), 4)]
    wanted, taken, done = [], set(), set()
    for d, r, g, x in sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1], -t[3], t[2])):
        if x >= 0.55 and (d, r) not in done and (d, g) not in taken:
            wanted.append((d, r, g, x))
            done.add((d, r))
            taken.add((d, g))
    out = greedy_match(spark.createDataFrame(rows, "doc_id long, ref long, got long, dice double"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, wanted))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_rule_outputs_of_one_small_file_are_made_by_the_whole_cluster(spark, tmp_path):
    spark.createDataFrame([(k, k % 7) for k in range(1, 200)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("rule_outputs", "fidelity_checks"):
        assert entry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_audio_and_long_texts_go_to_python_in_small_batches(spark):
    from plectrum.operators import chunks
    from plectrum.sources import wav

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.getAll.get(key)
    rows = spark.range(2).selectExpr("id AS doc_id", "0 AS chunk", "0 AS ord", "'s0' AS segment_id", "'uno' AS spoken_text", "false AS muted")
    try:
        for build in (lambda: wav.export(wav.with_audio(rows, "spoken_text")), lambda: chunks.plan_chunks(rows)):
            spark.conf.unset(key)
            build()
            assert int(spark.conf.get(key)) <= 512
        spark.conf.set(key, "77")
        chunks.plan_chunks(rows)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
