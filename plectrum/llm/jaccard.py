"""N-gram Jaccard join with set-relation skipping, up to connected components.

1. Texts become sets of hashed word shingles.  Equal sets are one set with a representative (the least
   doc_id) before anything is compared.
2. A count sketch of fixed width over all documents orders shingles, rare ones first; any fixed order
   gives exact results, a good one short lists.  A pair at the threshold shares a shingle
   among the first n - ceil(t n) + 1 of both, so those prefixes are the index.  In a shingle's
   list, sorted by set size, only neighbours within the size bound can be linked through it.
   Lists are never collected: a window over each list emits one edge a member.
3. The components of these candidate edges are the units of comparison.  A unit above a budget is
   split into blocks by set size, and blocks meet in pairs, but for pairs that the size
   bound skips; so no task holds an unbounded group and no pair is a row.  The texts of a block are stored
   once, in a file that all its tasks read: with B blocks they would else be shuffled some B times.
4. In a unit, block-skipping index lists by size and position find whether a set has any
   possible partner, and its overlaps with all others are derived from those of a similar set
   already done: only lists of shingles in which the two differ are read.  Each task gives one row a set
   (its local root and number of links).

Sets are compared by 64-bit hashes of shingles; a pair's result can differ from the words' own only if
two different shingles of that pair collide.

Edge cases: a null or blank text has an empty set and is linked with nothing, copies included; with fewer words
than a shingle the whole sequence is the one shingle; ties and repeated rows are copies of one set; rows with equal
doc_id count as one vertex; a null doc_id is never linked and has a null component; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectrum.llm.bytewise import NOT_SPACE, Words
from plectrum.llm.common import documents, open_for_write, quoted, read_or_map, scratch, written
from plectrum.llm.components import components, roots
from plectrum.llm.tokens import give_back, text_slices

PERCENT = 90
#: Words in a shingle.
WORDS = 3
#: Shingles in one block of a large unit; a task holds two blocks, some 130 bytes a shingle.
BUDGET = 1_000_000
CHUNKS = 16
BROADCAST_ROWS = 250_000
#: At most so many ids (8 bytes each) of rows to drop are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Bytes of text hashed at a time; a worker holds some forty times that.
SLICE = 1 << 20


def sketch_bits(df: DataFrame, least: int = 20, most: int = 24) -> int:
    """Sketch width by the planner's estimate of the input's size; it changes speed only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(most, round(math.log2(max(size, 1) / 64))))


def build_sketch(df: DataFrame, uri: str, bits: int, words: int = WORDS) -> tuple[str, ...]:
    """Counts of shingles over all documents by the low bits of their hash: the flat files of CHUNKS chunks, in order.

    Tasks send saturating 8-bit counts in compressed chunks; each chunk's sums saturate at 16 bits and are written by the
    task that made them, under a name of its own, so that the driver gets the names alone.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mask = np.zeros(1 << bits, "u4"), np.uint64((1 << bits) - 1)
        for batch in text_slices(batches, most=SLICE):
            runs = Words(batch.column("text"), NOT_SPACE).shingle_runs(words)
            np.add.at(total, (np.concatenate([np.zeros(0, "u8"), *runs]) & mask).astype("i8"), 1)
        parts = np.split(np.minimum(total, 255).astype("u1"), CHUNKS)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), "u1")
                old = sums.get(chunk)
                sums[chunk] = part.astype("u2") if old is None else np.minimum(old.astype("u4") + part, 65535).astype("u2")
        for chunk, part in sums.items():
            name = f"{uri}-{chunk}-{uuid.uuid4().hex}"
            with open_for_write(name) as f:
                f.write(part.astype("<u2").tobytes())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "name": [name]})

    summed = df.select("text").mapInArrow(count, "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(merge, "chunk int, name string")
    found = {r["chunk"]: r["name"] for r in summed.collect()}  # a name a chunk
    if len(found) < CHUNKS:  # no task has counted anything
        with open_for_write(uri) as f:
            f.write(bytes((2 << bits) // CHUNKS))
    return tuple(found.get(chunk, uri) for chunk in range(CHUNKS))


_SKETCHES: dict[tuple[str, ...], np.ndarray] = {}


def _sketch(names: tuple[str, ...]) -> np.ndarray:
    if names not in _SKETCHES:
        _SKETCHES.clear()
        _SKETCHES[names] = np.concatenate([np.frombuffer(read_or_map(name), "<u2") for name in names])
    return _SKETCHES[names]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def signed(df: DataFrame, sketch: tuple[str, ...], bits: int, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), fp (128-bit digest of the set), prefix (its rarest shingles in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = _sketch(sketch), np.uint64((1 << bits) - 1)
        for batch in text_slices(batches, most=SLICE):
            n, fp, prefix = [], [], []
            for s in Words(batch.column("text"), NOT_SPACE).shingles(words):
                n.append(len(s))
                if not len(s):
                    fp.append(None)
                    prefix.append(s.view("i8"))
                    continue
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rank = (counts[(s & mask).astype("i8")].astype("u8") << np.uint64(48)) | (s >> np.uint64(16))
                k = prefix_size(len(s), percent)
                first = np.argpartition(rank, k - 1)[:k] if k < len(s) else np.arange(len(s))
                prefix.append(s[first[np.argsort(rank[first], kind="stable")]].view("i8"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "fp": pa.array(fp, pa.binary()),
                    "prefix": pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "i8"), *prefix]), pa.int64())
                    ),
                }
            )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, fp binary, prefix array<long>")


def candidate_edges(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): in each shingle's list by size, every set and the first set of its run.

    A run breaks where the next set is too large for the one before: nothing across it can be linked.
    """
    posted = reps.select("rep", "n", F.explode("prefix").alias("token"))
    order = Window.partitionBy("token").orderBy("n", "rep")
    ran = posted.select("token", "rep", "n", F.coalesce(F.lag("n").over(order) * 100 < F.col("n") * percent, F.lit(True)).alias("new"))
    led = ran.select("rep", F.last(F.when(F.col("new"), F.col("rep")), ignorenulls=True).over(order).alias("lead"))
    return led.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))


def units(reps: DataFrame, labels: DataFrame, budget: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """rep, copies, unit, block, large: every set of a candidate component in its block; and unit, low, high: the tasks of the large ones.

    A small component is one task.  Of a large one, each block meets itself (low = high) and each
    block within the size bound.
    """
    members = reps.select("rep", "n", "copies").join(labels.select(F.col("node").alias("rep"), F.col("component").alias("unit")), "rep")
    members = written(members, scratch(reps.sparkSession, "jaccard-members"))
    # blocks are laid out over a unit's sizes, which are few; a size above the budget takes several, dealt by hash
    sizes, by_size = members.groupBy("unit", "n").agg(F.sum("n").alias("total")), Window.partitionBy("unit").orderBy("n")
    small = F.sum("total").over(Window.partitionBy("unit")) <= budget
    first = F.floor((F.sum("total").over(by_size) - F.col("total")) / budget)
    places = sizes.select("unit", "n", F.when(small, 0).otherwise(first).cast("long").alias("first"), F.when(small, 1).otherwise(F.ceil(F.col("total") / budget)).cast("long").alias("many"), (~small).alias("large"))
    block = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("many"))
    ranked = members.join(places, ["unit", "n"]).select("rep", "n", "copies", "unit", block.alias("block"), "large")
    ranked = written(ranked, scratch(reps.sparkSession, "jaccard-blocks"))
    spans = ranked.where("large").groupBy("unit", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = spans.alias("x"), spans.alias("y")
    meet = x.join(y, (F.col("x.unit") == F.col("y.unit")) & (F.col("x.block") <= F.col("y.block")) & ((F.col("x.block") == F.col("y.block")) | (F.col("x.most") * 100 >= F.col("y.least") * percent)))
    return ranked.select("rep", "copies", "unit", "block", "large"), meet.select(F.col("x.unit").alias("unit"), F.col("x.block").alias("low"), F.col("y.block").alias("high"))


def links_in_unit(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """For each set with links, its place and its partners' places; with two sides, across sides only.

    Sets are taken by size.  A set's possible partners come from the index of prefixes, whose lists are cut to the
    block of sizes in reach and tested by position; a set without any is skipped.  Overlaps with every set
    are counted along whole lists for a first set, and for a similar one derived from that one's: lists of
    shingles that only one of the two has are added or taken away.
    """
    m = len(sets)
    if m == 2:
        if side[0] != side[1] or side.max() == side.min():
            a, b = sets
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                return [(0, np.array([1])), (1, np.array([0]))]
        return []
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    by_token = np.argsort(flat, kind="stable")  # owners rise within a list
    new = np.ones(len(flat), bool)
    new[1:] = flat[by_token[1:]] != flat[by_token[:-1]]
    token = np.empty(len(flat), "i4")
    token[by_token] = np.cumsum(new) - 1
    starts = np.concatenate([[0], np.cumsum(size)])
    lists = np.repeat(np.arange(m, dtype="i4"), size)[by_token]
    n_values = int(new.sum())
    del flat, new, by_token
    count = np.bincount(token, minlength=n_values)
    list_at = np.concatenate([[0], np.cumsum(count)])
    # prefixes, rare shingles first
    prefix_tokens, prefix_places = [], []
    for i in range(m):
        own = token[starts[i] : starts[i + 1]]
        k = prefix_size(len(own), percent)
        first = own[np.lexsort((own, count[own]))[:k]]
        prefix_tokens.append(first)
        prefix_places.append(np.arange(k))
    p_token, p_place = np.concatenate(prefix_tokens), np.concatenate(prefix_places)
    p_owner = np.repeat(np.arange(m), [len(p) for p in prefix_tokens])
    p_order = np.argsort(p_token, kind="stable")
    p_owner, p_place = p_owner[p_order], p_place[p_order]
    p_at = np.concatenate([[0], np.cumsum(np.bincount(p_token, minlength=n_values))])
    low = np.searchsorted(size, -(-percent * size // 100), side="left")
    high = np.searchsorted(size, 100 * size // percent, side="right")
    sides = side[order]
    two = sides.max() != sides.min()

    def overlaps(tokens: np.ndarray) -> np.ndarray:
        if not len(tokens):
            return np.zeros(m, "i8")
        a, n = list_at[tokens], count[tokens]
        ends = np.cumsum(n)
        return np.bincount(lists[np.arange(ends[-1]) + np.repeat(a - (ends - n), n)], minlength=m)

    leaders: list[tuple[int, np.ndarray]] = []
    out = []
    for i in range(m):
        possible = False
        for place, t in enumerate(prefix_tokens[i]):
            a, b = p_at[t], p_at[t + 1]
            if b - a < 2:
                continue
            block = p_owner[a:b]
            x, y = np.searchsorted(block, low[i]), np.searchsorted(block, high[i])
            others = block[x:y]
            rest = 1 + np.minimum(size[i] - place - 1, size[others] - p_place[a + x : a + y] - 1)
            near = (100 + percent) * rest >= percent * (size[i] + size[others])
            if (near & (others != i)).any():  # the set itself may be out of its own bound where a smaller one is in
                possible = True
                break
        if not possible:
            continue
        own = token[starts[i] : starts[i + 1]]
        best = max(leaders, key=lambda x: x[1][i] / (size[x[0]] + size[i]), default=None)
        if best and 3 * best[1][i] > size[best[0]] + size[i]:
            lead = token[starts[best[0]] : starts[best[0] + 1]]
            shared = best[1] + overlaps(np.setdiff1d(own, lead, assume_unique=True)) - overlaps(np.setdiff1d(lead, own, assume_unique=True))
        else:
            shared = overlaps(own)
            leaders.append((i, shared))
            if len(leaders) > 64:
                leaders.pop(0)
        span = slice(low[i], high[i])
        linked = (100 + percent) * shared[span] >= percent * (size[i] + size[span])
        if two:
            linked &= sides[span] != sides[i]
        found = np.flatnonzero(linked) + low[i]
        found = found[found != i]
        if len(found):
            out.append((int(order[i]), order[found]))
    return out


LINKS = "node long, root long, links long"


def _links(sets: list[np.ndarray], reps: list[int], copies: list[int], sides: list[int], percent: int) -> Iterator[pa.RecordBatch]:
    """node, root, links of the sets of one task that have links."""
    found = links_in_unit(sets, np.array(sides), percent) if len(sets) > 1 else []
    if not found:
        return
    ids, many = np.array(reps), np.array(copies)
    node = ids[[i for i, _ in found]]
    a = np.repeat(node, [len(p) for _, p in found])
    nodes, top = roots(a, ids[np.concatenate([p for _, p in found])])
    links = [int(many[p].sum()) for _, p in found]
    yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "root": pa.array(top[np.searchsorted(nodes, node)], pa.int64()), "links": pa.array(links, pa.int64())})


def _texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The members with their texts, by unit and block."""
    if members.count() <= BROADCAST_ROWS:  # at most some 20 MB
        members = F.broadcast(members)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep")
    return texts.repartition("unit", "block").sortWithinPartitions("unit", "block", "rep").select("unit", "block", "rep", "copies", "text")


def compare(members: DataFrame, docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """node, root, links: for every set with links, of units that are one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, reps, copies = None, [], [], []
        for batch in text_slices(batches, most=SLICE):
            made = Words(batch.column("text"), NOT_SPACE).shingles(words)
            columns = [batch.column(c).to_pylist() for c in ("unit", "rep", "copies")]
            for s, unit, rep, n in zip(made, *columns, strict=True):
                if unit != key:
                    yield from _links(sets, reps, copies, [0] * len(sets), percent)
                    key, sets, reps, copies = unit, [], [], []
                sets.append(s)
                reps.append(rep)
                copies.append(n)
        yield from _links(sets, reps, copies, [0] * len(sets), percent)

    return _texts(members, docs).mapInArrow(run, LINKS)


def stored_blocks(members: DataFrame, docs: DataFrame, uri: str) -> DataFrame:
    """unit, block, name: a file below uri with the texts of each block."""
    schema = pa.schema({"rep": pa.int64(), "copies": pa.int64(), "text": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, file, writer, made = None, None, None, []
        for batch in text_slices(batches, most=SLICE):
            unit, block = batch.column("unit").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (block[1:] != block[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (unit[at], block[at]) != key:
                    if writer is not None:
                        writer.close()
                        file.close()
                    key = (unit[at], block[at])
                    made.append((int(unit[at]), int(block[at]), f"{uri}/{uuid.uuid4().hex}"))
                    file = open_for_write(made[-1][2])
                    writer = pa.ipc.new_stream(file, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(c).slice(at, to - at).cast(schema.field(c).type) for c in schema.names], schema=schema))
        if writer is not None:
            writer.close()
            file.close()
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["unit", "block", "name"])

    return _texts(members, docs).mapInArrow(run, "unit long, block long, name string")


def compare_blocks(meet: DataFrame, names: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """node, root, links: for every set with links, in each of its tasks over two blocks (or one) of a large unit."""
    spark = meet.sparkSession
    low, high = (names.select("unit", F.col("block").alias(side), F.col("name").alias(f"{side}_name")) for side in ("low", "high"))
    tasks = written(meet.join(low, ["unit", "low"]).join(high, ["unit", "high"]).select("unit", "low", "high", "low_name", "high_name"), scratch(spark, "jaccard-tasks"))
    # a number of its own, since rows so small would be put together in one partition
    width = max(1, min(tasks.count(), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def block(name: str) -> tuple[list[np.ndarray], list[int], list[int]]:
        sets, reps, copies = [], [], []
        for batch in pa.ipc.open_stream(pa.py_buffer(read_or_map(name))):
            sets += Words(batch.column("text"), NOT_SPACE).shingles(words)
            reps += batch.column("rep").to_pylist()
            copies += batch.column("copies").to_pylist()
        return sets, reps, copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None  # the lower block stays while tasks share it
        for batch in batches:
            for low_name, high_name in zip(batch.column("low_name").to_pylist(), batch.column("high_name").to_pylist(), strict=True):
                if low_name != held:
                    first = None
                    held, first = low_name, block(low_name)
                second = block(high_name) if high_name != low_name else ([], [], [])
                sides = [0] * len(first[0]) + [1] * len(second[0])
                yield from _links(first[0] + second[0], first[1] + second[1], first[2] + second[2], sides, percent)
        give_back()

    return tasks.repartition(width).sortWithinPartitions("unit", "low", "high").select("low_name", "high_name").mapInArrow(run, LINKS)


def join(df: DataFrame, percent: int = PERCENT, budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (rows linked with this one, copies included).

    Rows are linked if their sets of shingles of ``words`` words have a Jaccard similarity of ``percent`` or more.
    """
    spark = df.sparkSession
    bits = sketch_bits(df)
    sketch = build_sketch(df, scratch(spark, "jaccard-sketch") + "/counts.u2", bits, words)
    sets = written(signed(df, sketch, bits, percent, words), scratch(spark, "jaccard-sets"))
    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    least = known.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("x"), F.count(F.lit(1)).alias("copies"))
    reps = written(least.select("fp", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.prefix").alias("prefix"), "copies"), scratch(spark, "jaccard-reps"))
    labels = components(candidate_edges(reps, percent), "jaccard-candidates")
    members, meet = units(reps, labels, budget, percent)
    found = compare(members.where("NOT large").drop("large"), df, percent, words)
    large = members.where("large").drop("large")
    if not large.isEmpty():
        names = written(stored_blocks(large, df, scratch(spark, "jaccard-texts")), scratch(spark, "jaccard-names"))
        found = found.unionByName(compare_blocks(meet, names, percent, words))
    found = written(found, scratch(spark, "jaccard-links"))
    if found.groupBy("node").agg(F.count_distinct("root").alias("n")).where("n > 1").isEmpty():
        top = found.groupBy("node").agg(F.min("root").alias("component"))
    else:  # some sets were compared in several tasks
        top = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"), "jaccard-components")
    linked = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    final = (
        reps.select("fp", "rep", "copies")
        .join(top.withColumnRenamed("node", "rep"), "rep", "left")
        .join(linked, "rep", "left")
        .select("fp", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return sets.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(final, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def with_group(df: DataFrame, name: str, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """df and, under a name that it must not have, the component of each row that is linked with another; null for the others."""
    spark = df.sparkSession
    grouped = written(join(df, percent, words=words), scratch(spark, "jaccard-groups"))
    told = grouped.where("n_links > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias(name))
    if told.count() <= BROADCAST_IDS:
        told = F.broadcast(told)
    return df.join(told, "doc_id", "left").select(*quoted([*df.columns, name]))


def keep_one(df: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """df with one row of each group of linked rows: the least doc_id stays; rows outside groups all stay."""
    spark = df.sparkSession
    grouped = written(join(df, percent, words=words), scratch(spark, "jaccard-result"))
    gone = grouped.where("component_id <> doc_id").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = df.join(gone, "doc_id", "left_anti").select(*quoted(df.columns))
    again = grouped.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # rows that share an id and are linked are copies of one another
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*quoted(df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
