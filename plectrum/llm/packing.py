"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's ids are hashed into a signed count vector, scaled to unit length, projected to three
dimensions by a fixed random matrix and quantised; its Hilbert index is its place on the curve.
The curve is cut into ranges of near-equal token counts and each range is sorted by that key; the running
token count is cut every ``length`` ids, so only the very last sequence has padding.

The encoding is a written table, so nothing is encoded twice.  Documents stand in the order of (key, row), at every size.
Token counts by cell (the key's leading bits) fix where the ranges start; a cell above two ranges' share is
counted again by its key's next bits, down to single keys, and a key above it, such as a large group of copies, is parted
at quantiles of its rows' numbers.  Each step sees a bounded number of cells on the driver.  One shuffle then
brings each range together, and a range's base is the token sum of the ranges before it.

Edge cases: a null text is empty and has its end id alone; equal texts share a key and are ordered by
row; repeated rows are all packed; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.llm.common import documents, scratch, written
from plectrum.llm.tokens import binary_runs, default_path, id_width, library_encoder, text_slices, with_end

HASH_DIMS, DIMS, BITS = 64, 3, 10
#: Leading bits of a key that name its cell, and further bits that a heavy cell is split by at a time.
CELL_BITS, MORE_BITS = 18, 6
#: Ids in a range, some 16 MB; above MOST_RANGES of them, ranges grow instead.
RANGE_IDS, MOST_RANGES = 8_000_000, 20_000


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (n, dims), each coordinate below 2**bits.

    Coordinates are turned into the transposed index by undoing excess rotations from the top bit down,
    then Gray-encoded; the index reads the bits of all axes in turn, highest first.
    """
    x = [points[:, d].astype("uint64") for d in range(points.shape[1])]
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        low = q - one
        for d in range(n):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            if d:
                x[d] = x[d] ^ swap
        q >>= one
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    flip, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > one:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << one) | (((x[d] ^ flip) >> np.uint64(b)) & one)
    return key.astype("int64")


def buckets(size: int) -> np.ndarray:
    """For each id below size: its hashed dimension, plus HASH_DIMS if it counts down."""
    mixed = np.arange(size, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(58)) % np.uint64(HASH_DIMS) + np.uint64(HASH_DIMS) * ((mixed >> np.uint64(40)) & np.uint64(1))).astype("i8")


def curve_keys(ids: np.ndarray, bounds: np.ndarray, bucket: np.ndarray, seed: int = 7) -> np.ndarray:
    """The place on the curve of each document, whose ids lie between the bounds."""
    n = len(bounds) - 1
    place = np.repeat(np.arange(n) * (2 * HASH_DIMS), np.diff(bounds)) + bucket[ids]
    counts = np.bincount(place, minlength=n * 2 * HASH_DIMS).reshape(n, 2, HASH_DIMS)
    vector = (counts[:, 0] - counts[:, 1]).astype("float64")
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
    low = vector @ np.random.default_rng(seed).standard_normal((HASH_DIMS, DIMS))
    level = np.clip((np.tanh(low) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype("uint64")
    return hilbert_index(level, BITS)


def encode(df: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """doc_id, key, n_tokens, ids (little-endian unsigned, of ``width`` bytes, the end id last)."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        bucket = buckets(max(end_id, *encoder.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for batch in text_slices(batches):
            ids, bounds = with_end(*encoder.encode_flat(batch.column("text")), end_id)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "key": pa.array(curve_keys(ids, bounds, bucket), pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids": binary_runs(ids.astype(kind), bounds),
                }
            )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, n_tokens long, ids binary").withColumn("row", F.monotonically_increasing_id())


Start = tuple[int, int]  # key and row that a range starts at


def _counts(encoded: DataFrame, bits: int, within: list[int], step: int = 0) -> list[tuple[int, int]]:
    """(cell, tokens) of the cells named by a key's leading bits; within: of those cells of ``step`` bits fewer alone."""
    cell = F.shiftright("key", DIMS * BITS - bits)
    if within:
        heavy = encoded.sparkSession.createDataFrame([(c,) for c in within], "up long")
        encoded = encoded.join(F.broadcast(heavy), F.shiftright("key", DIMS * BITS - bits + step) == F.col("up"))
    return sorted((r["cell"], r["n"]) for r in encoded.groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("n")).collect())


def _quantiles(encoded: DataFrame, keys: dict[int, int]) -> dict[int, list[int]]:
    """For each key the row numbers that part its rows into so many parts."""
    spark = encoded.sparkSession
    told = spark.createDataFrame([(k,) for k in keys], "key long")
    rows = encoded.select("key", "row").join(F.broadcast(told), "key")
    most = max(keys.values())
    found = rows.groupBy("key").agg(F.percentile_approx("row", [i / most for i in range(1, most)], max(10_000, 4 * most)).alias("q")).collect()
    return {r["key"]: [r["q"][round(i * most / keys[r["key"]]) - 1] for i in range(1, keys[r["key"]])] for r in found}


def starts(encoded: DataFrame, share: int, bits: int = CELL_BITS) -> list[Start]:
    """Where the ranges of about ``share`` tokens start, in the order of (key, row).

    At most total / share cells are heavy, so each step counts 2**CELL_BITS or 2**MORE_BITS * total / share cells.
    """
    bits = min(bits, DIMS * BITS)
    fine: list[tuple[int, int]] = []  # first key of a cell and its tokens
    open_ = _counts(encoded, bits, [])
    heavy: dict[int, int] = {}
    while open_:
        low = DIMS * BITS - bits
        fine += [(c << low, n) for c, n in open_ if n <= 2 * share]
        wide = [(c, n) for c, n in open_ if n > 2 * share]
        if not low or not wide:
            heavy = {c: -(-n // share) for c, n in wide}
            fine += wide if not low else []
            break
        step = min(MORE_BITS, low)
        bits += step
        open_ = _counts(encoded, bits, [c for c, _ in wide], step)
    parted = _quantiles(encoded, heavy) if heavy else {}
    out, held = [], 0
    for key, n in sorted(fine):
        if not out or key in heavy or held + n > share:
            out.append((key, -1))
            held = 0
        held += n
        if key in heavy:
            out += [(key, row + 1) for row in sorted(set(parted[key]))]
            held = share  # the next cell starts a range
    return out


def part_of(keys: np.ndarray, rows: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The range of each (key, row): the last one that starts at it or before."""
    part = np.searchsorted(begin, keys, "right") - 1
    left = np.searchsorted(begin, keys, "left")
    for key in np.unique(keys[part > left]):  # a key that is parted
        a, b = np.searchsorted(begin, key, "left"), np.searchsorted(begin, key, "right")
        own = keys == key
        part[own] = a + np.maximum(np.searchsorted(row[a:b], rows[own], "right"), 1) - 1
    return part.astype("i4")


def sort_along(encoded: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The documents in their ranges (part), each sorted by (key, row), and the ids before each range."""
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    told = starts(encoded, max(RANGE_IDS, total // MOST_RANGES))
    begin, row = (np.array(x, "i8") for x in zip(*told, strict=True)) if told else (np.zeros(0, "i8"),) * 2

    @F.pandas_udf("int")
    def part(key: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(part_of(key.to_numpy(), number.to_numpy(), begin, row))  # 16 bytes a range

    placed = encoded.select(part("key", "row").alias("part"), "key", "doc_id", "n_tokens", "row", "ids")
    base, at = {}, 0
    for p, n in sorted(placed.groupBy("part").agg(F.sum("n_tokens")).collect()):  # one row a range
        base[p] = at
        at += n
    return placed.repartition(max(1, len(base)), "part").sortWithinPartitions("part", "key", "row"), base


def cut(ordered: DataFrame, base: dict[int, int], length: int, width: int) -> DataFrame:
    """The pieces of the documents in sequences of ``length`` ids."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for whole in batches:
            for batch in text_slices(iter([whole]), "ids"):
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
                for doc, n, ids, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "part")), strict=True):
                    if part != now:
                        now, at = part, base[part]
                    wide, start = np.frombuffer(ids, kind).astype("<u4"), 0
                    while start < n:
                        sequence, offset = divmod(at + start, length)
                        size = min(n - start, length - offset)
                        for k, v in zip(out, (doc, start, size, zlib.crc32(wide[start : start + size]), n, sequence, offset), strict=True):
                            out[k].append(v)
                        start += size
                    at += n
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return ordered.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    spark = df.sparkSession
    width = id_width(tokenizer, end_id)
    encoded = written(encode(df, tokenizer, end_id, width), scratch(spark, "pack-ids"))
    return cut(*sort_along(encoded), length, width)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path())
