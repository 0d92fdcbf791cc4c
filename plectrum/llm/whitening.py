"""Whitening: the leading principal components of embeddings in whole numbers, by block Lanczos, and rows projected on them.

The covariance is never formed.  A pass multiplies it with a block of vectors: every task centres its rows, multiplies
and emits a matrix of dimension times block, and Spark adds these up.  The driver holds the basis and its products
(dimension times the vectors passed so far), orthogonalised twice against all of itself.  Where a new block loses rank its lost
directions are drawn anew, orthogonal to the basis, so that the process goes on past an invariant space.  It ends when the
residuals of the wanted pairs are at rounding level, or the basis spans the whole space.

The fit list holds each vector once and is written to the shared folder, so a lost executor costs no more than reading
a part again.  Equal vectors are combined before they are shuffled: one that a third of the rows hold is no hot key.

Edge cases: rows whose vector is null or holds null, NaN or infinity are dropped; a vector shorter than the longest
counts as 0 in the places it lacks; repeated rows and null ids are projected like others; ties (equal eigenvalues) take any orthonormal
basis of their space; without rows or variance there are no components and so no rows, and a fit list of lower rank
than the components wanted has as many as its rank; a deviation beyond 64 bits is null; a value beyond 64 bits counts
as the nearest long.  :meth:`Whitening.transform` carries columns of any name and names its own with leading underscores where they clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plectrum.llm import common

SCALE = 256
COMPONENTS = 4
#: Vectors multiplied in a pass: some more than the wanted ones, so that few passes do.
BLOCK = 8
#: Eigenvalues below this share of the trace are rounding.
RANK = 1e-13
_EPS = float(np.finfo("f8").eps)
_LONG = 1 << 63


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """The entries times scale, rounded down; null where the vector is to be dropped."""
    doubles = embedding.cast("array<double>")
    fine = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(doubles, lambda c: F.floor(c * scale).cast("long")))


def _padded(x: Column, dim: int) -> Column:
    return F.when(F.size(x) >= dim, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(dim) - F.size(x), F.lit(0)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch of vectors of dim whole numbers as rows."""
    return np.asarray(column.flatten()).reshape(len(column), dim)


@dataclass(frozen=True)
class Centre:
    """The number of vectors and their exact sums."""

    n: int
    sums: tuple[int, ...]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean goes off exactly, the rest rounded once."""
        parts = [divmod(s, self.n) for s in self.sums]
        return x.astype("f8") - np.array([float(q) for q, _ in parts]) - np.array([r / self.n for _, r in parts])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n*x - S)**2, exact."""
        top = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
        bound = self.n * top + max(map(abs, self.sums), default=0)
        if bound * bound * max(len(self.sums), 1) < _LONG:
            gap = self.n * x - np.array(self.sums, "i8")
            return (gap * gap).sum(axis=1).tolist()
        gap = self.n * x.astype(object) - np.array(self.sums, object)
        return (gap * gap).sum(axis=1).tolist()


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums, in as many bits as they take."""
    top = max(abs(int(x.min())), abs(int(x.max())))
    return (x if top * len(x) < _LONG else x.astype(object)).sum(axis=0).tolist()


def _added(fit: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over the fit list of part(rows), a matrix of ``width`` columns: tasks emit one matrix each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                got = part(_matrix(b.column(0), dim))
                held = got if held is None else held + got
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype="i4")), pa.array(held.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    rows = fit.mapInArrow(work, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(width)]).collect()
    return np.array([list(r)[1:] for r in sorted(rows)])


_LIMB = 48


def _limbs(v: int) -> list[int]:
    """v in digits of 48 bits, the last one signed."""
    out = []
    while not -(1 << _LIMB) < v < 1 << _LIMB:
        out.append(v & ((1 << _LIMB) - 1))
        v >>= _LIMB
    return [*out, v]


def _added_exactly(fit: DataFrame, dim: int, part: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The sum over the fit list of part(rows), whole numbers of any size, which travel in digits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for b in batches:
            if b.num_rows:
                got = part(_matrix(b.column(0), dim))
                held = [a + g for a, g in zip(held, got, strict=True)] if held else got
        rows = [(i, j, d) for i, v in enumerate(held) for j, d in enumerate(_limbs(v))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "d"])

    rows = fit.mapInArrow(work, "i int, j int, d long").groupBy("i", "j").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d")).collect()
    out = [0] * (max((r["i"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["i"]] += int(r["d"]) << (_LIMB * r["j"])
    return out


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns, orthogonal to the basis, that span the block and, for what it lacks in rank, random directions."""
    wanted = min(block.shape[1], len(basis) - basis.shape[1])
    found = np.zeros((len(basis), 0))
    for column in [*block.T, *[None] * wanted]:
        if found.shape[1] == wanted:
            break
        all_ = np.hstack([basis, found])
        new = rng.standard_normal(len(basis)) if column is None else column
        size = np.linalg.norm(new) if column is None else scale
        for _ in range(3):  # twice is enough; the third time for directions that nearly vanish
            new = new - all_ @ (all_.T @ new)
        if np.linalg.norm(new) > 16 * _EPS * len(basis) * size:
            found = np.hstack([found, (new / np.linalg.norm(new))[:, None]])
    return found


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, seed: int = 20) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues and unit eigenvectors of a symmetric matrix known by its products, and the products taken."""
    rng = np.random.default_rng(seed)
    basis, products = np.zeros((dim, 0)), np.zeros((dim, 0))
    new, passes, last = _orthogonal(rng.standard_normal((dim, min(block, dim))), basis, 1.0, rng), 0, np.inf
    while True:
        got = multiply(new)
        passes += 1
        basis, products = np.hstack([basis, new]), np.hstack([products, got])
        small = basis.T @ products
        values, turns = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:wanted]
        values, turns = values[top], turns[:, top]
        vectors = basis @ turns
        scale = max(float(values[0]), 0.0)
        worst = float(np.linalg.norm(products @ turns - vectors * values, axis=0).max())
        settled = worst <= 4 * _EPS * np.sqrt(dim) * scale or (worst <= 1e-12 * scale and worst > last / 2)
        if basis.shape[1] >= dim or (settled and basis.shape[1] >= 2 * wanted):
            return values, np.linalg.qr(vectors)[0], passes
        last = worst
        new = _orthogonal(got, basis, max(scale, float(np.abs(got).max())), rng)


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column a component
    trace: float
    identity_error: float
    passes: int

    def transform(self, df: DataFrame, embedding: str = "embedding") -> DataFrame:
        """df's rows with a finite vector, and their deviation and whitened entries, one a component."""
        dim, centre, turn = len(self.centre.sums), self.centre, self.vectors / np.sqrt(self.values)
        boxed = df.select(F.struct(*[F.col(c) for c in common.quoted(df.columns)]).alias("_row"), whole_numbers(F.col(common.quoted([embedding])[0])).alias("_x")).where("_x IS NOT NULL")
        boxed = boxed.select("_row", F.slice(_padded(F.col("_x"), dim), 1, dim).alias("_x") if dim else F.col("_x"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dim)
                whitened = pa.array((centre.rows(x) @ turn).tolist(), pa.list_(pa.float64()))
                deviation = pa.array([d if d < _LONG else None for d in centre.deviations(x)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), deviation, whitened], names=["_row", "_deviation", "_whitened"])

        out = boxed.mapInArrow(work, StructType([boxed.schema["_row"], *StructType.fromDDL("_deviation long, _whitened array<double>").fields]))
        names = common.free_names(df.columns, "deviation", "whitened")
        return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], F.col("_deviation").alias(names[0]), F.col("_whitened").alias(names[1]))


def fit(df: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean, components and shares of the distinct finite vectors of df."""
    spark = df.sparkSession
    x = df.select(whole_numbers(F.col(common.quoted([embedding])[0])).alias("x")).where("x IS NOT NULL")
    dim = x.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return Whitening(Centre(0, ()), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    rows = common.written(x.select(_padded(F.col("x"), dim).alias("x")).distinct(), common.scratch(spark, "fit-list"))
    n, *sums = _added_exactly(rows, dim, lambda x: [len(x), *_exact_sum(x)])
    centre = Centre(n, tuple(sums))
    (spread,) = _added_exactly(rows, dim, lambda x: [sum(centre.deviations(x))])
    trace = spread / n**3

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.rows(x)
            return c.T @ (c @ block)

        return _added(rows, dim, part, block.shape[1]) / n

    if not spread:
        return Whitening(centre, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, 0)
    values, vectors, passes = lanczos(multiply, dim, min(components, dim))
    real = values > RANK * trace
    values, vectors = values[real], vectors[:, real]
    turn = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    *second, first = _added(rows, dim, moments, len(values)) / n
    error = float(np.abs(np.array(second) - np.outer(first, first) - np.eye(len(values))).max())
    return Whitening(centre, values, vectors, trace, error, passes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(rows)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    out = model.transform(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return out.select(
        "vec_id",
        (F.col("_i") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_i")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
