"""Connected components of an edge table by alternating star contraction on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectrum.llm.common import scratch, written

EDGES = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        low = np.minimum(x, y)
        before = top.copy()
        np.minimum.at(top, x, low)
        np.minimum.at(top, y, low)
        while True:
            jumped = top[top]
            if (jumped == top).all():
                break
            top = jumped
        if (top == before).all():
            return nodes, nodes[top]


def contract(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Stars with the same components: each task contracts runs of at most ``most`` of its edges."""

    def star(held: list[np.ndarray]) -> pa.RecordBatch:
        nodes, top = roots(np.concatenate(held[0::2]), np.concatenate(held[1::2]))
        low = nodes != top
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[low], pa.int64()), "b": pa.array(top[low], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held += [batch.column("a").to_numpy(), batch.column("b").to_numpy()]
            n += batch.num_rows
            if n >= most:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return edges.select("a", "b").mapInArrow(run, EDGES)


def _moved(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (a, b) as (b, m) with the m of their a.

    They meet by a's complement: the aggregation that made least is dealt by a itself, and a join on top of its
    shuffle could not split a hot node's edges; with shuffles of its own the adaptive skew join can.
    """
    left = edges.select(F.bitwise_not("a").alias("k"), "b")
    return left.join(least.select(F.bitwise_not("a").alias("k"), "m"), "k").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _moved(both.where("b > a"), least).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _moved(down, least).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its least node) of every node of the edges (a, b), as a written table.

    Rounds go on until the edges stand still as stars; their number grows with the logarithm of the
    longest path.  Each round is a written table, and hot nodes are pre-aggregated.
    """
    spark = edges.sparkSession
    now = written(contract(edges), scratch(spark, name))
    state = None
    while True:
        # stars: no node is both a leaf and a centre, and no leaf has two centres
        facts = now.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts == state or not facts[0]:
            break
        state = facts
        now = written(_small_star(_large_star(now)), scratch(spark, name))
    centres = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
