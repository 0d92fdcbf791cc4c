"""Resharding by minimum-cost flow: the fewest bytes move, and only affected files are rewritten.

A layout is a written table with a manifest: one row a file (a block) with its shard, rows and bytes.
From the old shard sizes and the new capacities a minimum-cost flow gives how many bytes each old
shard sends to each new one (staying costs nothing).  An old shard's files, laid end to end, are dealt to its flows in turn:
a file inside one flow changes hands in the manifest alone; a file across a boundary between flows is cut by rows,
largest row first to the shard that lacks most, and rewritten as files of their new shards.  Only
cut files are read for that and shuffled.  A row's slot is its file's base in the shard plus its place in the
file.  The manifest stays a table: the driver sees one number a shard and the cut files, at most one for each pair of shards.

Edge cases: a null text has no bytes and size 1; a null key goes to a fixed old shard; equal rows are
placed each; a shard may stay empty; an empty table gives no rows; further columns of the input, whatever
their names, are carried through the files unchanged, in one column of their own.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plectrum.llm.common import documents, quoted, scratch, written

MANIFEST = "path string, shard int, n_rows long, n_bytes long"
MAX_ROWS = 50_000  # a file: a block is never larger
#: An index of at most so many files (some 200 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_FILES = 200_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j, all supply sent, at the least total cost.

    Successive shortest paths with potentials on the bipartite graph source, old, new, sink.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards are too small")
    n, m = len(supply), len(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    to, room, price, out = [], [], [], [[] for _ in range(size)]

    def arc(a: int, b: int, cap: int, c: int) -> None:
        for x, y, r, p in ((a, b, cap, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost[i][j])
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential, left = [0] * size, sum(supply)
    while left:
        best, via = [float("inf")] * size, [-1] * size
        best[source], heap = 0, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in out[x]:
                if room[e] and (nd := d + price[e] + potential[x] - potential[to[e]]) < best[to[e]]:
                    best[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        potential = [p + (b if b < float("inf") else 0) for p, b in zip(potential, best, strict=True)]
        push, x = left, sink
        while x != source:
            push = min(push, room[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
        left -= push
    return [[room[first + 2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def even(total: int, n: int) -> list[int]:
    """n capacities that differ by one at most."""
    return [total // n + (j < total % n) for j in range(n)]


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def lay_out(df: DataFrame, shard: Column, folder: str) -> DataFrame:
    """Writes df by shard without a shuffle: each task adds its files to the shards' folders.

    A row of df is one column of the files, so its names cannot clash with the layout's.
    """
    row = F.struct(*[F.col(q).alias(c) for q, c in zip(quoted(df.columns), df.columns, strict=True)])
    laid = df.select(row.alias("row"), size_of().alias("size"), shard.cast("int").alias("shard"))
    laid.write.option("maxRecordsPerFile", MAX_ROWS).partitionBy("shard").parquet(folder)
    return _manifest(_files(df, folder), folder)


def _files(df: DataFrame, folder: str, paths: list[str] | None = None) -> DataFrame:
    """row, size, shard, path and place in the file of a layout's rows, or of some of its files."""
    schema = StructType([StructField("row", df.schema), StructField("size", LongType()), StructField("shard", IntegerType())])
    read = df.sparkSession.read.schema(schema).option("basePath", folder).parquet(*(paths or [folder]))
    return read.select("row", "size", "shard", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))


def _manifest(files: DataFrame, folder: str) -> DataFrame:
    rows = files.groupBy("path", "shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").cast("long").alias("n_bytes"))
    return written(rows, folder + "-manifest")


def plan(manifest: DataFrame, n_old: int, capacity: list[int]) -> tuple[DataFrame, dict[str, list[tuple[int, int]]]]:
    """The manifest's uncut files with their ``new`` shard, and of each cut file the (bytes, new shard) pieces."""
    spark = manifest.sparkSession
    supply = [0] * n_old
    for r in manifest.groupBy("shard").agg(F.sum("n_bytes").alias("n")).collect():  # a row a shard
        supply[r["shard"]] = r["n"]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(n_old)])
    bounds = []
    for i, sent in enumerate(flow):
        at = 0
        # the staying flow first: it keeps the largest files
        for j, n in sorted(((j, n) for j, n in enumerate(sent) if n), key=lambda x: (x[0] != i, -x[1])):
            bounds.append((i, at, at + n, j))
            at += n
    flows = spark.createDataFrame(bounds, "shard int, low long, high long, new int")
    end = F.sum("n_bytes").over(Window.partitionBy("shard").orderBy(F.desc("n_bytes"), "path").rowsBetween(Window.unboundedPreceding, 0))
    laid = manifest.withColumn("end", end).withColumn("start", F.col("end") - F.col("n_bytes"))
    met = laid.join(F.broadcast(flows), ["shard"]).where("start < high AND end > low")  # n_old * n_new rows
    met = met.withColumn("piece", F.least("end", "high") - F.greatest("start", "low"))
    cuts: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in met.where("piece < n_bytes").select("path", "piece", "new").orderBy("path", "start").collect():  # two rows a boundary
        cuts[r["path"]].append((r["piece"], r["new"]))
    return met.where("piece = n_bytes").select("path", "shard", "n_rows", "new"), dict(cuts)


def _deal(block: pd.DataFrame) -> pd.DataFrame:
    """The rows of one cut block, largest first, each to the shard that still wants most of it."""
    block = block.sort_values(["size", "place"], ascending=[False, True], kind="stable")
    heap = [(-want, j) for want, j in zip(block["want"].iloc[0], block["to"].iloc[0], strict=True)]
    heapq.heapify(heap)
    new = []
    for size in block["size"]:
        want, j = heap[0]
        heapq.heapreplace(heap, (want + size, j))
        new.append(j)
    return block[["path", "place"]].assign(new=np.array(new, "int32"))


def _rewrite(df: DataFrame, old_folder: str, cuts: dict[str, list[tuple[int, int]]], folder: str) -> DataFrame:
    """Writes the rows of the cut files, and of no others, as files of their new shards."""
    spark = df.sparkSession
    cut = _files(df, old_folder, list(cuts))
    pieces = spark.createDataFrame([(p, [b for b, _ in c], [j for _, j in c]) for p, c in cuts.items()], "path string, want array<long>, to array<int>")
    rows = cut.select("path", "place", "size").join(F.broadcast(pieces), "path")  # a cut file for each boundary of flows at most
    placed = rows.groupBy("path").applyInPandas(_deal, "path string, place long, new int")
    moved = cut.drop("shard").join(placed, ["path", "place"]).withColumnRenamed("new", "shard")
    moved.select("row", "size", "shard").write.partitionBy("shard").parquet(folder)
    return _files(df, folder)


def reshard(df: DataFrame, old_folder: str, manifest: DataFrame, n_old: int, n_new: int, folder: str) -> DataFrame:
    """The rows of a layout in n_new shards of near-equal bytes.

    All columns of df, then _size, _shard, _slot, _old_shard (-1 in rewritten files) and _moved; where df has one of
    these names, all five get further underscores in front.
    """
    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    whole, cuts = plan(manifest, n_old, even(total, n_new))
    both = _files(df, old_folder)
    files = whole.select("path", "new", "n_rows", F.col("shard").alias("old_shard"))
    if cuts:
        again = _rewrite(df, old_folder, cuts, folder + "/rewritten")
        both = both.unionByName(again)
        files = files.unionByName(_manifest(again, folder + "/new").select("path", F.col("shard").alias("new"), "n_rows", F.lit(-1).alias("old_shard")))
    before = F.sum("n_rows").over(Window.partitionBy("new").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    # one row a file; cut files have none, so they drop out of the old layout
    index = written(files.select("path", "new", "old_shard", F.coalesce(before, F.lit(0)).alias("base")), folder + "/index")
    if index.count() <= BROADCAST_FILES:
        index = F.broadcast(index)
    slot, moved = (F.col("base") + F.col("place")).cast("long"), F.col("old_shard") != F.col("new")
    added, mark = {"size": F.col("size"), "shard": F.col("new"), "slot": slot, "old_shard": F.col("old_shard"), "moved": moved}, "_"
    while {(mark + a).lower() for a in added} & {c.lower() for c in df.columns}:
        mark += "_"
    return both.drop("shard").join(index, "path").select(*[F.col("row").getField(c).alias(c) for c in df.columns], *[x.alias(mark + a) for a, x in added.items()])


N_SHARDS = 16


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout shards by source, so one shard holds the hot source; the new one is even."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(N_SHARDS))
    folder = scratch(spark, "shards")
    manifest = lay_out(docs, old, folder + "/old")
    out = reshard(docs, folder + "/old", manifest, N_SHARDS, N_SHARDS, folder)
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
