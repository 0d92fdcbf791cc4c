"""BPE by a minimal acyclic transducer of frequent words, with exact merging of all others.

Words (pretokens of the byte-level pattern) are counted over the whole corpus; the most frequent are
compiled into a minimal acyclic automaton.  Words are added in sorted order and finished suffixes are shared
through a register of states.  Each arc carries how many words lie before it, so a path's sum numbers
the words 0..n-1 without gaps (the transducer's output), and the number selects the id sequence.
The automaton is one flat file in the shared folder, memory-mapped by the workers; a slice's new words
walk it together.  Words that it lacks go through the merge table by rank, one merge a word and step.
A bounded memory of past pieces sits before both.

Decoding concatenates the ids' bytes and replaces invalid UTF-8, as the library's byte-level decoder.

Edge cases: a null text is empty and has no ids; the tokenizer's own special strings are split off
before pretokens, as the library does; texts beyond the code points on which all Unicode versions agree are
pretokenised by the library itself; repeated rows are encoded each; an empty table gives no rows and
an empty lexicon; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.llm.common import documents, open_for_write, read_or_map, scratch, written
from plectrum.llm.tokens import PRETOKEN, Memory, PieceEncoder, binary_runs, byte_alphabet, default_path, gather, pieces, settled, text_slices, texts_of

#: Ids are below 2 ** ID_BITS; NO_PAIR is above every rank.
ID_BITS, NO_PAIR = 20, 1 << 60


class Lexicon:
    """A read-only automaton over flat arrays: find(word) gives the word's number or -1.

    Layout: magic, counts of states, arcs, words, ids (five 64-bit integers), then the sorted arcs as
    state * 256 + byte (u8), arc targets (u4), words before each arc (u4), id starts of the words (u4),
    ids (u4) and the finality of the states (u1).  Words are followed all at once, a byte a step.
    """

    MAGIC = 0x4D41545332

    def __init__(self, data) -> None:
        view = memoryview(data)
        magic, states, arcs, words, ids = np.frombuffer(view, "<i8", 5).tolist()
        if magic != self.MAGIC:
            raise ValueError("not a lexicon file")
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(view, kind, n, at)
            at += part.nbytes
            return part

        self.words = words
        self._arcs, self._targets, self._before = take("<u8", arcs), take("<u4", arcs), take("<u4", arcs)
        self._id_starts, self._ids, self._final = take("<u4", words + 1), take("<u4", ids), take("u1", states)

    def find_many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number, or -1, of each word, given by its place in the bytes of data."""
        out = np.full(len(starts), -1)
        open_, state, number, step = np.arange(len(starts)), np.zeros(len(starts), "u8"), np.zeros(len(starts), "i8"), 0
        while len(open_):
            ended = sizes[open_] == step
            done = ended & (self._final[state] != 0)
            out[open_[done]] = number[done]
            open_, state, number = open_[~ended], state[~ended], number[~ended]
            wanted = state << np.uint64(8) | data[starts[open_] + step]
            arc = np.searchsorted(self._arcs, wanted)
            hit = np.flatnonzero(arc < len(self._arcs))
            hit = hit[self._arcs[arc[hit]] == wanted[hit]]
            arc = arc[hit]
            open_, state, number, step = open_[hit], self._targets[arc].astype("u8"), number[hit] + self._before[arc], step + 1
        return out

    def find(self, word: bytes) -> int:
        return int(self.find_many(np.frombuffer(word, "u1"), np.zeros(1, "i8"), np.array([len(word)]))[0])

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in a row and the number of each one's."""
        starts = self._id_starts[numbers].astype("i8")
        sizes = self._id_starts[numbers + 1] - starts
        return gather(self._ids, starts, sizes), sizes

    def ids(self, number: int) -> bytes:
        return self.ids_of(np.array([number]))[0].tobytes()

    @property
    def _bytes(self) -> np.ndarray:
        return self._arcs & np.uint64(255)


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The flat file of (word, ids) entries; any order, no repeated words."""
    items = sorted(entries)
    register: dict[tuple, int] = {}
    finals, arcs = [], []  # of frozen states

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            arcs.append(list(node[1].items()))
        return register[key]

    path: list[list] = [[False, {}]]  # the open states of the last word: [final, {byte: frozen target}]
    last = b""
    for word, _ in items:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            done = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(done)
        for _ in word[same:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1][last[len(path) - 1]] = freeze(done)
    root = path[0]
    below = []  # words from each frozen state; targets are frozen before their sources
    for final, out in zip(finals, arcs, strict=True):
        below.append(int(final) + sum(below[t] for _, t in out))
    states = [(root[0], sorted(root[1].items())), *((f, sorted(a)) for f, a in zip(finals, arcs, strict=True))]
    labels, targets, before = [], [], []
    for state, (final, out) in enumerate(states):
        number = int(final)
        for b, t in out:
            labels.append(state << 8 | b)
            targets.append(t + 1)
            before.append(number)
            number += below[t]
    id_starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in items])]) if items else np.zeros(1)
    flat = [x for _, ids in items for x in ids]
    head = np.array([Lexicon.MAGIC, len(states), len(labels), len(items), len(flat)], "<i8")
    parts = [head, np.array(labels, "<u8"), *(np.array(x, "<u4") for x in (targets, before, id_starts, flat)), np.array([f for f, _ in states], "u1")]
    return b"".join(p.tobytes() for p in parts)


class Merger:
    """The vocabulary, the merge ranks and the byte strings of the ids, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        value = {c: b for b, c in enumerate(byte_alphabet())}
        self.single = [vocab[c] for c in byte_alphabet()]
        #: For two ids as one integer: the rank and the merged id as one integer.
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        self._single = np.array(self.single)
        self._pairs = np.array(sorted(self.rank), "i8")
        self._pair_ranks = np.array([self.rank[p] for p in self._pairs.tolist()], "i8")
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for shown, i in vocab.items():
            strings[i] = bytes(value[c] for c in shown)
        for shown, i in self.special.items():
            strings[i] = shown.encode()
        self.strings = strings
        #: Of two bytes, as _ranks.
        self._byte_ranks = np.full((256, 256), NO_PAIR)
        if len(self._pairs):
            a, b = np.divmod(np.arange(1 << 16), 256)
            self._byte_ranks = self._ranks(self._single[a], self._single[b]).reshape(256, 256)

    def merge(self, word: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost first, until none is left.

        Pairs wait in a heap and symbols in a linked list, so a long word costs n log n.
        """
        rank, low, n = self.rank, (1 << ID_BITS) - 1, len(word)
        ids = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int]] = []

        def wait(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = ids[i] << ID_BITS | ids[after[i]]
                if pair in rank:
                    heapq.heappush(waiting, (rank[pair], i, pair))

        for i in range(n - 1):
            wait(i)
        while waiting:
            merged, i, pair = heapq.heappop(waiting)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << ID_BITS | ids[j] != pair:
                continue  # one of the two has changed since
            ids[i], ids[j], after[i] = merged & low, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            wait(before[i])
            wait(i)
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank and merged id as one integer for each pair, or NO_PAIR."""
        wanted = a << ID_BITS | b
        at = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
        return np.where(self._pairs[at] == wanted, self._pair_ranks[at], NO_PAIR)

    def merge_many(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge, for words whose bytes lie in a row: all ids in a row and the number of each word's.

        Each step merges one pair in every word that still has one.
        """
        if len(self._pairs) == 0:
            return self._single[data].astype("<u4"), sizes
        symbol, word = self._single[data], np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(data), NO_PAIR)
        rank[:-1] = np.where(word[1:] == word[:-1], self._byte_ranks[data[:-1], data[1:]], NO_PAIR)
        done_symbols, done_words, low = [], [], (1 << ID_BITS) - 1
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sizes_now = np.diff(first, append=len(word))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes_now)
            ready = least == NO_PAIR
            if ready.any():
                done_symbols.append(symbol[ready])
                done_words.append(word[ready])
                symbol, word, rank, least = symbol[~ready], word[~ready], rank[~ready], least[~ready]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost of each word
            symbol[at] = rank[at] & low
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            rank[at] = NO_PAIR
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # every merge before has taken one place
            right = at[at + 1 < len(word)]
            right = right[word[right] == word[right + 1]]
            rank[right] = self._ranks(symbol[right], symbol[right + 1])
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self._ranks(symbol[left], symbol[left + 1])
        symbols, words = np.concatenate([np.zeros(0, "i8"), *done_symbols]), np.concatenate([np.zeros(0, "i8"), *done_words])
        return symbols[np.argsort(words, kind="stable")].astype("<u4"), np.bincount(words, minlength=len(sizes))


class LexiconEncoder(PieceEncoder):
    #: Words of more bytes are merged one by one.
    LONG = 64

    def __init__(self, tokenizer: str, lexicon: Lexicon | None) -> None:
        super().__init__()
        self.merger, self.lexicon, self._path, self._library = Merger(tokenizer), lexicon, tokenizer, None
        special = sorted(self.merger.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._marks = [s[:2] for s in special]
        ends = np.cumsum([0] + [len(s) for s in self.merger.strings])
        self._from, self._sizes = ends[:-1], np.diff(ends)
        self._flat = np.frombuffer(b"".join(self.merger.strings), "u1")

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        if settled(text):
            return PRETOKEN.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that the automaton has get its ids; all others are merged."""
        raw = [w.encode() for w in words]
        data, sizes = np.frombuffer(b"".join(raw), "u1"), np.fromiter(map(len, raw), "i8", len(raw))
        starts = np.cumsum(sizes) - sizes
        number = self.lexicon.find_many(data, starts, sizes) if self.lexicon else np.full(len(raw), -1)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero((number < 0) & (sizes <= self.LONG))
        long = np.flatnonzero((number < 0) & (sizes > self.LONG))
        found = [self.lexicon.ids_of(number[known])] if len(known) else []
        found.append(self.merger.merge_many(gather(data, starts[new], sizes[new]), sizes[new]))
        for i in long:
            ids = self.merger.merge(raw[i])
            found.append((np.array(ids, "<u4"), np.array([len(ids)])))
        flat, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.argsort(np.concatenate([known, new, long]), kind="stable")
        ends = np.cumsum(counts)
        return gather(flat, (ends - counts)[back], counts[back]), counts[back]

    def encode_odd(self, text: str) -> np.ndarray:
        parts = self._special.split(text) if self._special else [text]
        own = [np.array([self.merger.special[p]], "<u4") if k % 2 else self.word_ids(self.pretokens(p))[0] for k, p in enumerate(parts)]
        return np.concatenate(own)

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' byte strings in a row."""
        return gather(self._flat, self._from[ids], self._sizes[ids]).tobytes()


_READY: dict[tuple[str, str], LexiconEncoder] = {}


def lexicon_encoder(tokenizer: str, uri: str) -> LexiconEncoder:
    """One encoder a worker process."""
    if (tokenizer, uri) not in _READY:
        _READY.clear()
        _READY[tokenizer, uri] = LexiconEncoder(tokenizer, Lexicon(read_or_map(uri)))
    return _READY[tokenizer, uri]


def count_words(df: DataFrame, tokenizer: str, most: int = 1_000_000) -> DataFrame:
    """Pretokens of all texts with their counts: counted by piece in each task, then by word.

    A task holds at most about ``most`` distinct pieces, or as many characters as 16 of each, before it hands its counts on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, heads, n, held = LexiconEncoder(tokenizer, None), Memory(), Counter(), 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words: Counter = Counter()
            for piece, times in chain(heads.items(), seen.counted()):
                for w in encoder.pretokens(piece):
                    words[w] += times
            keys, values = list(words), list(words.values())
            for a in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_pydict({"word": keys[a : a + 50_000], "n": pa.array(values[a : a + 50_000], pa.int64())})

        for batch in text_slices(batches):
            cut = [pieces(t) for t in texts_of(batch)]
            own = [c.pop(0) for c in cut]
            heads.update(own)
            fresh = seen.look_up([f" {p}" for p in chain.from_iterable(cut)])[1]
            n, held = n + len(fresh), held + sum(map(len, fresh)) + sum(map(len, own))
            if n > most or held > 16 * most:
                yield from flush()
                seen, heads, n, held = Memory(), Counter(), 0, 0
        yield from flush()

    return df.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int, steps: int = 16) -> DataFrame:
    """The words of the highest counts, whole steps of counts only, ``size`` at most.

    A step is a range of counts, ``steps`` to a doubling; the driver gets one number a step, a thousand at most.
    """
    stepped = counts.withColumn("step", F.floor(F.log2("n") * steps).cast("int"))
    least, total = None, 0
    for row in sorted(stepped.groupBy("step").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["step"]):
        total += row["k"]
        if total > size:
            break
        least = row["step"]
    return stepped.where(F.col("step") >= least if least is not None else F.lit(False)).select("word", "n")


def build_lexicon(df: DataFrame, tokenizer: str, uri: str, size: int = 65_536, longest: int = 64) -> str:
    """Writes the automaton of the most frequent words of at most ``longest`` bytes, ``size`` at most.

    Words are counted over all texts; those found once are not frequent and not kept for the choice.
    """
    counts = count_words(df, tokenizer).where((F.octet_length("word") <= longest) & (F.col("n") > 1))
    top = frequent(written(counts, scratch(df.sparkSession, "lexicon-counts")), size)
    merger = Merger(tokenizer)
    words = [r["word"].encode() for r in top.select("word").collect()]  # at most size words
    with open_for_write(uri) as f:
        f.write(compile_lexicon((w, merger.merge(w)) for w in words))
    return uri


def encode(df: DataFrame, tokenizer: str, uri: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) by the automaton at uri."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = lexicon_encoder(tokenizer, uri)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": binary_runs(*encoder.encode_flat(batch.column("text")))})

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def round_trip(df: DataFrame, tokenizer: str, uri: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from those ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = lexicon_encoder(tokenizer, uri)
        shown = [str(i) for i in range(len(encoder.merger.strings))]
        for batch in text_slices(batches):
            ids, bounds = encoder.encode_flat(batch.column("text"))
            raw = encoder.decode(ids)
            bytes_before = np.concatenate([[0], np.cumsum(encoder._sizes[ids])])[bounds].tolist()
            seen, decoded = [], []
            for k, (at, to) in enumerate(pairwise(bounds.tolist())):
                seen.append(hashlib.sha256(",".join(map(shown.__getitem__, ids[at:to].tolist())).encode()).hexdigest())
                text = raw[bytes_before[k] : bytes_before[k + 1]].decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_sha256": seen, "decoded_sha256": decoded})

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = documents(spark, sf_dir), default_path()
    uri = build_lexicon(docs, tokenizer, scratch(spark, "lexicon") + "/words.mat")
    return round_trip(docs, tokenizer, uri)
