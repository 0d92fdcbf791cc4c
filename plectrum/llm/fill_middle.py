"""Fill-in-middle: documents cut into prefix, middle and suffix at line ends and written in another order.

Where a cut falls depends on all that precedes it, yet no text is read from its start to its end by one task.  An
automaton counts the line ends and looks for markers; the scan of a stretch of text, started in an unknown state, is a
function: for each state it may start in, the state it ends in and what it counted.  Two such functions of neighbouring
stretches compose into the one of both, and composition is associative, so functions are combined in a tree.  The root
tells how many lines a document has; walking down with the state and the number still wanted finds the line end that a
cut falls on.

Documents of up to ``GIANT`` characters are one stretch and stay where they were read.  Longer ones are cut into
stretches of ``STRETCH`` characters that Spark deals to all tasks; each yields a row of some hundred bytes, a
document's rows meet, and the two cuts found go back to the document's row.  The way differs with the length, the
result does not.

Edge cases: a null text is empty, an empty one has no line and stays plain, as does a text that holds a marker; a null
key draws its numbers from the salt alone; equal rows get equal output; an empty table gives no rows; columns of any
name are carried, and result columns that clash are named with leading underscores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plectrum.llm import common

#: What begins the prefix, the suffix and the middle in the output (fixed by the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = 7
#: Characters of a stretch, and of the longest text that is not dealt out in stretches.
STRETCH = 1 << 14
GIANT = 1 << 16
#: Characters whose functions a worker holds at once.
TOGETHER = 1 << 18

UNITS, MARKERS = 0, 1  # what is counted


class Automaton:
    """Counts unit ends and markers.  ``step[state, class]`` is the next state, ``count[state, class]`` what is counted.

    A state is a pair: whether a unit is open, and the longest end of the text read that begins a marker; states that
    nothing tells apart are merged.
    """

    def __init__(self, end: str = "\n", markers: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> None:
        signs = sorted({end, *"".join(markers)})
        begun = sorted({m[:i] for m in markers for i in range(len(m))}, key=len)
        pairs = [(unit, b) for unit in (0, 1) for b in begun]
        step = np.zeros((len(pairs), len(signs) + 1), "i8")
        count = np.zeros((len(pairs), len(signs) + 1, 2), "i8")
        for i, (_, b) in enumerate(pairs):
            for c, sign in enumerate(["", *signs]):  # class 0: every other character
                read = b + sign if sign else ""
                tails = [read[j:] for j in range(len(read) + 1)]
                step[i, c] = pairs.index((int(sign != end), next(t for t in tails if t in begun)))
                count[i, c] = sign == end, any(t in markers for t in tails)
        group = np.zeros(len(pairs), "i8")
        group[[i for i, p in enumerate(pairs) if p[0]]] = 1  # an open unit counts once more at the end of the text
        while True:
            told = [(group[i], *group[step[i]], *count[i].ravel()) for i in range(len(pairs))]
            finer = np.array([told.index(t) for t in told])
            if len(set(finer)) == len(set(group)):
                break
            group = finer
        first = sorted(set(finer.tolist()))
        number = {f: i for i, f in enumerate(first)}
        self.step = np.array([[number[finer[x]] for x in step[f]] for f in first], "u1")
        self.count = count[first].astype("i4")
        self.open = np.array([bool(pairs[f][0]) for f in first])
        self.start = number[finer[pairs.index((0, ""))]]
        self.states = len(first)
        top = max(map(ord, signs))
        self._class = np.zeros(top + 2, "u1")
        self._class[[ord(s) for s in signs]] = np.arange(1, len(signs) + 1)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the characters of all texts, the characters' places, and how many each text has.

        Of a run of class 0 the first is left, as reading it again changes nothing.
        """
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        kind = self._class[np.minimum(code, len(self._class) - 1)]
        sizes = np.array([len(t) for t in texts], "i8")
        starts = np.cumsum(sizes) - sizes
        kept = kind > 0
        kept[1:] |= kind[:-1] > 0
        kept[starts[sizes > 0]] = True
        at = np.flatnonzero(kept)
        n = np.searchsorted(at, starts + sizes) - np.searchsorted(at, starts)
        return kind[at], at - np.repeat(starts, n), n

    def functions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.step.T[symbols], self.count.transpose(1, 0, 2)[symbols]


@lru_cache(2)
def automaton() -> Automaton:
    return Automaton()


class Trees:
    """The functions of consecutive stretches, combined pairwise level by level, for many texts at once.

    ``ends[i, s]`` and ``counts[i, s]`` belong to stretch i entered in state s; text g has ``sizes[g]`` stretches.
    """

    def __init__(self, ends: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.levels = [(ends, counts, np.cumsum(sizes) - sizes)]
        self.sizes = [sizes]
        while len(sizes) and sizes.max() > 1:
            place = np.arange(len(ends)) - np.repeat(self.levels[-1][2], sizes)
            left = np.flatnonzero(place % 2 == 0)
            paired = place[left] + 1 < np.repeat(sizes, sizes)[left]
            right = left[paired] + 1
            via = ends[left[paired]].astype("i8")
            joined, summed = ends[left].copy(), counts[left].copy()
            joined[paired] = np.take_along_axis(ends[right], via, 1)
            summed[paired] += np.take_along_axis(counts[right], via[:, :, None], 1)
            sizes = (sizes + 1) // 2
            ends, counts = joined, summed
            self.levels.append((ends, counts, np.cumsum(sizes) - sizes))
            self.sizes.append(sizes)

    def whole(self, g: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The function of the whole text, None for a text without stretches."""
        ends, counts, first = self.levels[-1]
        return (ends[first[g]], counts[first[g]]) if self.sizes[-1][g] else None

    def select(self, g: int, state: int, wanted: int) -> tuple[int, int, int]:
        """The stretch of text g in which the wanted unit ends, the state it is entered in and the units still wanted there."""
        node = 0
        for (ends, counts, first), sizes in zip(self.levels[-2::-1], self.sizes[-2::-1], strict=True):
            node *= 2
            i = first[g] + node
            if counts[i, state, UNITS] < wanted and node + 1 < sizes[g]:
                wanted -= int(counts[i, state, UNITS])
                state = int(ends[i, state])
                node += 1
        return node, state, wanted


def _cuts(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def _together(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of at most TOGETHER characters, or one."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > TOGETHER:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _outcome(a: Automaton, end: np.ndarray, count: np.ndarray) -> tuple[int, bool]:
    """The units of a text, with one left open, and whether it holds a marker."""
    s = a.start
    return int(count[s, UNITS]) + bool(a.open[end[s]]), bool(count[s, MARKERS])


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


FOUND = "_n long, _marked boolean, _lo long, _hi long"


def _whole_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts of one stretch each: lines, markers and the characters before either cut."""
    a, texts = automaton(), _texts(batch.column("_text"))
    h1, h2 = (batch.column(c).to_pylist() for c in ("_h1", "_h2"))
    found = []
    for part in _together(texts):
        own = texts[part]
        symbols, at, sizes = a.symbols(own)
        trees, first = Trees(*a.functions(symbols), sizes), np.cumsum(sizes) - sizes
        for g, text in enumerate(own):
            whole = trees.whole(g)
            n, marked = _outcome(a, *whole) if whole else (0, False)
            place = []
            for cut in _cuts(n, h1[part.start + g], h2[part.start + g]):
                if cut == 0 or cut == n:  # the last unit may end with the text alone
                    place.append(len(text) if cut else 0)
                else:
                    leaf, _, _ = trees.select(g, a.start, cut)
                    place.append(int(at[first[g] + leaf]) + 1)
            found.append((n, marked, *place))
    return _with(batch, ["_row", "_text", "_h3", "_h4"], found, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), ("_n", "_marked", "_lo", "_hi"))


def _with(batch: pa.RecordBatch, kept: list[str], rows: list[tuple], kinds: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    """The kept columns of a batch and those of the rows."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=[*kept, *names])


STRETCHES = "_g long, _k int, _h1 long, _h2 long, _chars long, _ends array<int>, _counts array<long>"


def _stretch_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The function of each stretch."""
    a, texts = automaton(), _texts(batch.column("_stretch"))
    rows = []
    for part in _together(texts):
        own = texts[part]
        symbols, _, sizes = a.symbols(own)
        trees = Trees(*a.functions(symbols), sizes)
        rows += [(len(t), *(x.ravel().tolist() for x in trees.whole(g))) for g, t in enumerate(own)]
    return _with(batch, ["_g", "_k", "_h1", "_h2"], rows, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), ("_chars", "_ends", "_counts"))


#: For either cut the stretch, the state it is entered in, and the units still wanted; -1 where the cut is at the text's end.
RESOLVED = "_g long, _n long, _marked boolean, _k1 int, _s1 int, _w1 long, _k2 int, _s2 int, _w2 long"


def _resolve(table: pa.Table) -> pa.Table:
    """A document's stretches: lines, markers and the stretches in which the cuts fall."""
    a, table = automaton(), table.sort_by("_k")
    ends = np.array(table["_ends"].to_pylist(), "i8")
    counts = np.array(table["_counts"].to_pylist(), "i8").reshape(len(ends), a.states, 2)
    tree = Trees(ends, counts, np.array([len(ends)]))
    n, marked = _outcome(a, *tree.whole(0))
    out = [table["_g"][0].as_py(), n, marked]
    for cut in _cuts(n, table["_h1"][0].as_py(), table["_h2"][0].as_py()):
        out += (0, a.start, 0) if cut == 0 else (-1, 0, 0) if cut == n else tree.select(0, a.start, cut)
    kinds = (pa.int64(), pa.int64(), pa.bool_(), *(pa.int32(), pa.int32(), pa.int64()) * 2)
    names = [c.split()[0] for c in RESOLVED.split(", ")]
    return pa.table([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=names)


def _place(text: str, k: int, state: int, wanted: int) -> int:
    """The characters of a text before a cut that was resolved to stretch k."""
    if k < 0 or wanted == 0:
        return len(text) if k < 0 else k * STRETCH
    a = automaton()
    symbols, at, sizes = a.symbols([text[k * STRETCH : (k + 1) * STRETCH]])
    leaf, _, _ = Trees(*a.functions(symbols), sizes).select(0, state, wanted)
    return k * STRETCH + int(at[leaf]) + 1


def _locate_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents with their resolved cuts: the characters before either cut."""
    texts = batch.column("_text")
    told = batch.select(["_n", "_marked", "_k1", "_s1", "_w1", "_k2", "_s2", "_w2"]).to_pylist()
    rows = []
    for i, r in enumerate(told):
        text = texts[i].as_py()
        rows.append((r["_n"], r["_marked"], *(_place(text, r[f"_k{j}"], r[f"_s{j}"], r[f"_w{j}"]) for j in (1, 2))))
    return _with(batch, ["_row", "_text", "_h3", "_h4"], rows, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), ("_n", "_marked", "_lo", "_hi"))


def _drawn(key: Column, salt: int) -> list[Column]:
    """Four numbers from the key: 8-digit groups of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def _giants(giants: DataFrame) -> DataFrame:
    """Documents in stretches over all tasks."""
    spark = giants.sparkSession
    # written once, so that the numbers of the rows hold whatever is run again
    kept = common.written(giants.withColumn("_g", F.monotonically_increasing_id()), common.scratch(spark, "long-texts"))
    stretches = kept.select("_g", "_h1", "_h2", F.posexplode(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))).alias("_k", "_stretch"))
    functions = stretches.repartition("_g", "_k").mapInArrow(lambda it: map(_stretch_batch, it), STRETCHES)
    resolved = functions.groupBy("_g").applyInArrow(_resolve, RESOLVED)
    schema = StructType([*(kept.schema[c] for c in ("_row", "_text", "_h3", "_h4")), *StructType.fromDDL(FOUND).fields])
    return kept.join(resolved, "_g").mapInArrow(lambda it: map(_locate_batch, it), schema)


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", salt: int = SALT, percent: int = 100, spm_percent: int = 50, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all) and n_units, form, prefix_chars, middle_chars and output.

    ``percent`` of the documents are cut, the others stay plain; ``spm_percent`` of these have the suffix first.
    """
    keep = df.columns if keep is None else keep
    quoted = common.quoted
    boxed = df.select(F.struct(*[F.col(c) for c in quoted(keep)]).alias("_row"), F.coalesce(F.col(quoted([text])[0]), F.lit("")).alias("_text"), *_drawn(F.col(quoted([key])[0]), salt))
    schema = StructType([*(boxed.schema[c] for c in ("_row", "_text", "_h3", "_h4")), *StructType.fromDDL(FOUND).fields])
    near = boxed.where(F.length("_text") <= GIANT).mapInArrow(lambda it: map(_whole_batch, it), schema)
    found = near.unionByName(_giants(boxed.where(F.length("_text") > GIANT)))
    plain = (F.col("_text") == "") | F.col("_marked") | (F.col("_h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    lo, hi = F.col("_lo").cast("int"), F.col("_hi").cast("int")
    prefix, suffix = F.substring("_text", F.lit(1), lo), F.substring("_text", hi + 1, F.length("_text"))
    middle = F.substring("_text", lo + 1, hi - lo)
    p, s, m = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix), F.concat(F.lit(MIDDLE), middle)
    output = F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    cut = F.col("_form") != "plain"
    names = common.free_names(keep, "n_units", "form", "prefix_chars", "middle_chars", "output")
    values = (F.col("_n"), F.col("_form"), F.when(cut, F.col("_lo")), F.when(cut, F.col("_hi") - F.col("_lo")), output)
    return found.withColumn("_form", form).select(*[F.col("_row").getField(c).alias(c) for c in keep], *[v.alias(n) for v, n in zip(values, names, strict=True)])


def restored(output: Column, form: Column) -> Column:
    """The text back from an output and its form."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.documents(spark, sf_dir), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
