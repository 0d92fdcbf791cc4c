"""Exact ranks of whole tables without one sort in one task.

Values fall into ranges between approximate quantiles; counts a range, cumulated, tell in which ranges the wanted ranks
lie, and only these ranges are sorted, each by itself.  The bounds change the balance alone, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a key: a search of eight steps a row, and a sort of about one in this many of its distinct values.
RANGES = 256


def _range_of(value: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are below the value: by halving."""
    steps = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def at_ranks(rows: DataFrame, ranks: Column) -> DataFrame:
    """key, rank, value, tie of the rows at the wanted ranks (from 0) of each key in the order of (value, tie).

    rows: key, value (a number, not null), tie and count, the number of rows that a row stands for.  ranks: an array of
    longs from ``n``, the number of rows of a key, and ``key``; keys are few.
    """
    bounds = rows.groupBy("key").agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("bounds"), F.sum("count").cast("long").alias("n"))
    dealt = rows.join(F.broadcast(bounds.select("key", "bounds")), "key").withColumn("range", _range_of(F.col("value"), F.col("bounds"))).drop("bounds")
    sums = dealt.groupBy("key", "range").agg(F.sum("count").cast("long").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows a key
    spans = sums.withColumn("before", before)
    wanted = bounds.select("key", F.explode(F.array_distinct(ranks)).alias("rank"))
    held = spans.join(F.broadcast(wanted), "key").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
    held = held.groupBy("key", "range", "before").agg(F.collect_list("rank").alias("ranks"))
    own = dealt.join(F.broadcast(held), ["key", "range"])  # the ranges that hold a rank
    to = F.sum("count").over(Window.partitionBy("key", "range").orderBy("value", "tie").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    own = own.withColumn("_to", to).withColumn("rank", F.explode("ranks"))
    return own.where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("count"))).select("key", "rank", "value", "tie")


def percentiles(df: DataFrame, wanted: dict[str, tuple[float, ...]]) -> DataFrame:
    """name, p, value (double): sorted[min(n - 1, floor(n * p))] of each named column, nulls left out, all in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in wanted])).alias("x")
    counted = df.select(each).select("x.*").where("value IS NOT NULL").groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))
    shares = F.lit(None).cast("array<double>")
    for name, ps in wanted.items():
        shares = F.when(F.col("key") == name, F.array(*[F.lit(float(p)) for p in ps])).otherwise(shares)
    rank = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    found = at_ranks(counted.withColumn("tie", F.lit(0)), F.transform(shares, rank))
    sizes = counted.groupBy("key").agg(F.sum("count").cast("long").alias("n"))
    asked = sizes.select("key", "n", F.explode(shares).alias("p")).withColumn("rank", rank(F.col("p")))  # a row a share
    return found.join(F.broadcast(asked), ["key", "rank"]).select(F.col("key").alias("name"), "p", "value")
