"""Components against a dense eigensolver, exact deviations, and tables that could trip the fit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plectrum.llm import whitening as w

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, wanted=4):
    """By a dense covariance of exact whole numbers."""
    told = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(x) for _, x in told), default=0)
    told = [(i, tuple([*x, *[0] * (dim - len(x))])) for i, x in told]
    fit = sorted(set(x for _, x in told))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    gaps = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(gaps.T @ gaps / n)
    order = np.argsort(values)[::-1][:wanted]
    values, vectors = values[order], vectors[:, order]
    out = {}
    for i, x in told:
        gap = [n * c - s for c, s in zip(x, sums, strict=True)]
        out[i] = (n, sum(g * g for g in gap), np.array(gap, float) / n @ vectors / np.sqrt(values))
    return out, values / np.trace(gaps.T @ gaps / n)


def held(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROWS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return w.query(spark, str(tmp_path)).collect()


def made(n=300, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(dim) * np.linspace(3, 0.2, dim)).astype("f4").tolist(), 0) for i in range(n)]


def test_query_against_a_dense_solver(spark, tmp_path):
    rows = made()
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(200)] + [(2000, None, 1), (2001, [*hot[:-1], None], 1), (2002, [*hot[:-1], float("nan")], 1), (2003, [*hot[:-1], float("-inf")], 1), (2004, [-0.0] * 12, 1)]
    rows += [(2005, [0.001, -0.001] + [0.5] * 10, 1)]
    got = held(spark, tmp_path, rows)
    want, shares = brute(rows)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k) for i in want for k in (1, 2, 3, 4))
    signs = {}
    for r in got:
        n, deviation, whitened = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] / shares[k] - 1) < 1e-12 and r["identity_error"] < 1e-10
        if abs(whitened[k]) > 0.1:
            signs.setdefault(k, math.copysign(1, whitened[k] * r["whitened"]))
    for r in got:
        assert abs(r["whitened"] - signs[r["component"] - 1] * want[r["vec_id"]][2][r["component"] - 1]) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_low_rank_ties_and_empty_tables(spark, tmp_path):
    assert held(spark, tmp_path, []) == [] and held(spark, tmp_path, [(1, None, 0)]) == [] and held(spark, tmp_path, [(1, [], 0)]) == []
    assert held(spark, tmp_path, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]) == []  # no variance
    line = held(spark, tmp_path, [(i, [float(i), 2.0 * i, 0.0, 0.0, 1.0, 3.0], 0) for i in range(50)])
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12 and line[0]["identity_error"] < 1e-10
    corners = [(i, [float(i >> j & 1) for j in range(6)], 0) for i in range(64)]  # six equal eigenvalues
    got = held(spark, tmp_path, corners)
    assert len(got) == 256 and all(abs(r["explained"] - 1 / 6) < 1e-12 for r in got) and got[0]["identity_error"] < 1e-10


def test_short_vectors_count_as_zeros_and_huge_ones_do_not_crash(spark, tmp_path):
    rows = [(i, v[: 12 - i % 3], 0) for i, v, _ in made(60)]
    got, (want, _) = held(spark, tmp_path, rows), brute(rows)
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d) for i, (_, d, _) in want.items()}
    got = held(spark, tmp_path, [(i, [1e30 if i == 3 else float(i), 1.0], 0) for i in range(20)])
    assert {r["vec_id"] for r in got} == set(range(20)) and {r["deviation"] for r in got if r["vec_id"] == 3} == {None}


@pytest.mark.parametrize(("dim", "rank"), [(1, 1), (3, 3), (40, 2), (64, 64), (200, 200), (200, 5)])
def test_lanczos_against_a_dense_solver(dim, rank):
    rng = np.random.default_rng(dim + rank)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = np.zeros(dim)
    values[:rank] = 2.0 ** -np.arange(rank) if rank < 60 else np.linspace(5, 1, rank)
    full = q * values @ q.T
    k = min(4, rank)
    got, vectors, passes = w.lanczos(lambda b: full @ b, dim, min(4, dim))
    assert np.allclose(got[:k], values[:k], rtol=1e-12) and np.allclose(np.abs((q[:, :k] * vectors[:, :k]).sum(axis=0)), 1, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12) and passes <= -(-dim // min(8, dim)) + 1


def test_breakdown_draws_new_directions():
    """A start within an invariant space would never meet the rest."""
    full = np.diag([1.0] * 30 + [7.0] * 3 + [5.0])
    got, vectors, _ = w.lanczos(lambda b: full @ b, 34, 4, block=1)
    assert np.allclose(got, [7, 7, 7, 5]) and np.allclose(full @ vectors, vectors * got, atol=1e-10)


def test_columns_of_any_name_are_carried(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "x", "dot") for i in range(9)], "vec_id long, embedding array<double>, deviation string, `a.b` string")
    out = w.fit(df).transform(df)
    assert out.columns == [*df.columns, "_deviation", "_whitened"] and out.where(F.size("_whitened") == 2).count() == 9
