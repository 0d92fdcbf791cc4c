"""Byte-level BPE through the tokenizers library, word by word with a bounded memory of past words.

The library's pattern always starts a new pretoken at a single space between two non-space
characters, and merges never cross pretokens.  So a text is cut there, each distinct piece is encoded
once by the library, and a text's ids are its pieces' ids in a row: equal to encoding the whole text.
Pieces are cut and made distinct in Arrow, numbered by one lookup each, and a slice's ids are
gathered from flat arrays at once.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the plain space and the line feed, as Python's \s or Unicode see it.
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


#: Code points below this have the same classes in every Unicode version in use.
SETTLED = 0x250


def _class(letter: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SETTLED) if unicodedata.category(chr(c))[0] == letter)


#: The byte-level pretoken pattern (fixed value), with its letter and number classes below SETTLED.
PRETOKEN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+".replace("{L}", _class("L")).replace("{N}", _class("N"))
)
#: What PRETOKEN may split otherwise than the library: separator controls (white space to Python alone), later code points.
_UNSETTLED = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")


#: A control that no settled text holds, and the characters that stand for themselves in byte-level vocabularies.
_BETWEEN = "\x1f"
_SHOWN_AS_IS = {_BETWEEN, *map(chr, range(0x21, 0x7F))}


def settled(text: str) -> bool:
    """Whether PRETOKEN splits this text as the library does."""
    return not _UNSETTLED.search(text)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte value in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    spare = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


def pieces(text: str) -> list[str]:
    """The text cut at single spaces between non-space characters; the spaces are dropped."""
    plain = "  " not in text and " \n" not in text and "\n " not in text and text[:1] not in " \n" and text[-1:] not in " \n"
    if plain and not _RARE_SPACE.search(text):
        return text.split(" ")
    return _INNER_SPACE.split(text)


#: White space beyond ASCII as UTF-8 (fixed values): the byte before the last, and the range of the last.
_WIDE_SPACE = ((0xC2, 0x85, 0x85), (0xC2, 0xA0, 0xA0), (0x9A, 0x80, 0x80), (0x80, 0x80, 0x8A), (0x80, 0xA8, 0xA9), (0x80, 0xAF, 0xAF), (0x81, 0x9F, 0x9F))


def single_spaced(column: pa.Array) -> np.ndarray:
    """Texts that are cut at each of their spaces: no space at an edge or beside white space, and none but spaces and line feeds.

    Some texts without any such trouble fail the test too; they take the longer way.
    """
    flat = column.cast(pa.large_binary())
    n = len(flat)
    offsets = np.frombuffer(flat.buffers()[1], "<i8", n + 1, flat.offset * 8) if n else np.zeros(1, "i8")
    if not offsets[-1] > offsets[0]:
        return np.ones(n, bool)
    data = np.frombuffer(flat.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    low = np.flatnonzero(data <= 0x20)
    value = data[low]
    odd = low[(value != 0x0A) & ((value <= 0x0D) & (value >= 0x09) | (value >= 0x1C) & (value < 0x20))]
    beside = np.flatnonzero((np.diff(low) == 1) & ((value[1:] == 0x20) | (value[:-1] == 0x20)) & (np.minimum(value[1:], value[:-1]) >= 0x0A))
    high = np.flatnonzero(data >= 0x80)
    high = high[1:][np.diff(high) == 1]
    last, before = data[high], data[high - 1]
    wide = [high[(before == x) & (last >= a) & (last <= b)] for x, a, b in _WIDE_SPACE]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    fine = np.ones(n, bool)
    some = np.flatnonzero(ends > starts)
    edges = np.isin(data[starts[some]], (0x20, 0x0A)) | np.isin(data[ends[some] - 1], (0x20, 0x0A))
    fine[some[edges]] = False
    # two neighbours in different texts are edges of theirs
    for places in (odd, low[beside], *wide):
        fine[np.searchsorted(ends, places, side="right")] = False
    return fine


class Memory:
    """Strings with their ids in flat arrays, bounded by count and by characters."""

    #: Longer strings are forgotten when the memory is trimmed.
    LONGEST = 256
    #: Characters that stay within the bounds.
    ROOM = 8 << 20

    def __init__(self) -> None:
        self._numbers: dict[str, int] = {}
        self._held, self._seen = 0, np.zeros(0, "i8")
        self.starts, self.sizes, self.ids = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "<u4")

    def look_up(self, keys: list[str], distinct: bool = False) -> tuple[np.ndarray, list[str]]:
        """The number of each key, and the keys not seen before, whose ids must be added next; distinct: no key comes twice."""
        numbers = self._numbers
        at = np.fromiter(map(numbers.get, keys, repeat(-1)), "i8", len(keys))
        gaps = np.flatnonzero(at < 0)
        missed = [keys[i] for i in gaps.tolist()]
        fresh, known = missed if distinct else list(dict.fromkeys(missed)), len(numbers)
        numbers.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        at[gaps] = np.arange(known, len(numbers)) if distinct else np.fromiter(map(numbers.__getitem__, missed), "i8", len(missed))
        seen = np.bincount(at, minlength=len(numbers))
        seen[: len(self._seen)] += self._seen
        self._seen = seen
        self._held += sum(map(len, fresh))
        return at, fresh

    def counted(self) -> Iterator[tuple[str, int]]:
        """All strings and how often they were looked up since the last trim."""
        return zip(self._numbers, self._seen.tolist(), strict=True)

    def add(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids in a row for the strings of these numbers."""
        more = len(self._numbers) - len(self.starts)
        if more:
            self.starts, self.sizes = np.append(self.starts, np.zeros(more, "i8")), np.append(self.sizes, np.zeros(more, "i8"))
        self.starts[numbers], self.sizes[numbers] = np.cumsum(sizes) - sizes + len(self.ids), sizes
        self.ids = np.concatenate([self.ids, ids])

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings in a row and the number of each one's."""
        sizes = self.sizes[numbers]
        return gather(self.ids, self.starts[numbers], sizes), sizes

    def __len__(self) -> int:
        return len(self._numbers)

    def trim(self, limit: int) -> None:
        """Beyond the bounds the strings stay that were seen again, the most frequent half at most."""
        if len(self._numbers) <= limit and self._held <= self.ROOM:
            return
        keys = list(self._numbers)
        again = np.flatnonzero(self._seen > 1)
        again = np.sort(again[np.argsort(-self._seen[again], kind="stable")[: limit // 2]])
        again = np.array([i for i in again.tolist() if len(keys[i]) <= self.LONGEST], "i8")
        again = again[np.cumsum([len(keys[i]) for i in again.tolist()]) <= self.ROOM // 2]
        keys = [keys[i] for i in again.tolist()]
        if len(self.starts):
            self.ids, self.sizes = gather(self.ids, self.starts[again], self.sizes[again]), self.sizes[again]
            self.starts = np.cumsum(self.sizes) - self.sizes
        self._seen, self._held = np.ones(len(keys), "i8"), sum(map(len, keys))
        self._numbers = dict(zip(keys, range(len(keys)), strict=True))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat with these starts and sizes, in a row."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


class PieceEncoder:
    """Encodes texts by pieces and pretokens; subclasses give the ids of pretokens and of odd texts."""

    #: Pieces remembered; half as many pretokens are.
    limit = 300_000

    def __init__(self) -> None:
        self._pieces, self._words = Memory(), Memory()  # pieces after a space

    #: The starts of the tokenizer's own special strings.
    _marks: list[str] = []

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pretokens in a row and the number of each one's."""
        raise NotImplementedError

    def encode_odd(self, text: str) -> np.ndarray:
        """The ids of a text that may hold special strings or that PRETOKEN may split otherwise."""
        raise NotImplementedError

    def _odd(self, text: str) -> bool:
        return any(m in text for m in self._marks) or not settled(text)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_words, through the memory of pretokens."""
        memory = self._words
        at, fresh = memory.look_up(words)
        if fresh:
            memory.add(np.arange(len(memory) - len(fresh), len(memory)), *self.encode_words(fresh))
        return memory.get(at)

    def _learn(self, fresh: list[str]) -> None:
        """Gives the newest pieces of the memory their ids.

        Even pieces are split into pretokens as one text.  One that is a single pretoken is encoded; the
        first pretoken of any other is itself a piece, looked up and encoded as such.
        """
        memory, joined = self._pieces, " " + " ".join(fresh)
        number = np.arange(len(memory) - len(fresh), len(memory))
        if joined.count(" ") != len(fresh) or self._odd(joined):
            odd = np.array([" " in p or self._odd(p) for p in fresh])
            each = [self.encode_odd(" " + fresh[i]) for i in np.flatnonzero(odd).tolist()]
            memory.add(number[odd], np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], "i8"))
            fresh, number = [fresh[i] for i in np.flatnonzero(~odd).tolist()], number[~odd]
            joined = " " + " ".join(fresh)
        if not fresh:
            return
        words = PRETOKEN.findall(joined)
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, fresh), "i8", len(fresh)) + 1))  # each piece's last word
        count = np.diff(last, prepend=-1)
        single = count == 1
        if single.all():
            memory.add(number, *self.encode_words(words))
            return
        first = last - count + 1
        heads = [words[i][1:] for i in first[~single].tolist()]
        if "" in heads:  # the space is a pretoken of its own, which no piece is
            self._learn_word_by_word(number, words, last)
            return
        at, more = memory.look_up(heads)
        new = np.concatenate([number[single], np.arange(len(memory) - len(more), len(memory))])
        memory.add(new, *self.encode_words([words[i] for i in first[single].tolist()] + [" " + w for w in more]))
        begins = np.zeros(len(words), bool)
        begins[first] = True
        begins[first[single]] = True
        inner = np.flatnonzero(~begins)
        ids, sizes = self.word_ids([words[i] for i in inner.tolist()])
        # the runs of all other pieces: the head's, then those of its other words
        starts, lengths = np.zeros(len(words), "i8"), np.zeros(len(words), "i8")
        starts[inner], lengths[inner] = np.cumsum(sizes) - sizes + len(memory.ids), sizes
        starts[first[~single]], lengths[first[~single]] = memory.starts[at], memory.sizes[at]
        used = np.repeat(~single, count)
        flat = gather(np.concatenate([memory.ids, ids]), starts[used], lengths[used])
        memory.add(number[~single], flat, np.diff(np.cumsum(lengths * used)[last[~single]], prepend=0))

    def _learn_word_by_word(self, number: np.ndarray, words: list[str], last: np.ndarray) -> None:
        ids, sizes = self.word_ids(words)
        self._pieces.add(number, ids, np.diff(np.cumsum(sizes)[last], prepend=0))

    def _heads(self, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids in a row and the number of each first piece's."""
        odd = {i for i, h in enumerate(heads) if self._odd(h)}
        cut = [[] if i in odd else PRETOKEN.findall(h) for i, h in enumerate(heads)]
        ids, word_sizes = self.word_ids(list(chain.from_iterable(cut)))
        ends = np.concatenate([[0], np.cumsum(word_sizes)])[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype("i8")]
        if not odd:
            return ids, np.diff(ends)
        each = [self.encode_odd(h) if i in odd else ids[ends[i] : ends[i + 1]] for i, h in enumerate(heads)]
        return np.concatenate(each), np.array([len(x) for x in each])

    def encode_flat(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (unsigned 32-bit integers) and the bounds of each text's; null is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        on = gc.isenabled()
        gc.disable()  # nothing cyclic is made here, but very many lists that a collection would walk
        try:
            plain = single_spaced(column)
            if plain.all():
                return self._encode_plain(column)
            parts = [(np.flatnonzero(plain), *self._encode_plain(column.filter(pa.array(plain))))]
            parts.append((np.flatnonzero(~plain), *self._encode_cut([pieces(t) for t in column.filter(pa.array(~plain)).to_pylist()])))
        finally:
            if on:
                gc.enable()
        rows, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        sizes = np.concatenate([np.diff(p[2]) for p in parts])
        back = np.argsort(rows)
        return gather(ids, (np.cumsum(sizes) - sizes)[back], sizes[back]), np.concatenate([[0], np.cumsum(sizes[back])])

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose pieces lie between single spaces: cut and made distinct in Arrow, so Python sees each piece once."""
        if not len(column):
            return np.zeros(0, "<u4"), np.zeros(1, "i8")
        lists = pc.split_pattern(column, " ")
        offsets, coded = lists.offsets.to_numpy().astype("i8"), lists.flatten().dictionary_encode()
        offsets -= offsets[0]
        code = coded.indices.to_numpy()
        heads = coded.dictionary.take(pa.array(code[offsets[:-1]])).to_pylist()
        code = np.delete(code, offsets[:-1])
        used = np.bincount(code, minlength=len(coded.dictionary)) > 0
        at = np.full(len(used), -1)
        names = coded.dictionary.filter(pa.array(used))
        # no piece holds a space: one string is made and split, some times faster than one object each
        at[used] = self._known(pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), " ")[0].as_py().split(" ") if len(names) else [], distinct=True)
        return self._joined(heads, at[code], np.diff(offsets) - 1)

    def _encode_cut(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Texts given as their pieces."""
        heads = [c.pop(0) for c in cut]
        at = self._known(list(chain.from_iterable(cut)))
        return self._joined(heads, at, np.fromiter(map(len, cut), "i8", len(cut)))

    def _known(self, names: list[str], distinct: bool = False) -> np.ndarray:
        """The numbers of pieces, all of them with ids in the memory from now on."""
        at, fresh = self._pieces.look_up(names, distinct)
        if fresh:
            self._learn(fresh)
        return at

    def _joined(self, heads: list[str], at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts from their first pieces and the numbers and counts of the others."""
        memory = self._pieces
        head_ids, head_sizes = self._heads(heads)
        places = np.cumsum(counts) - counts
        starts = np.insert(memory.starts[at], places, np.cumsum(head_sizes) - head_sizes + len(memory.ids))
        sizes = np.insert(memory.sizes[at], places, head_sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts + 1)])]
        out = gather(np.concatenate([memory.ids, head_ids]), starts, sizes)
        memory.trim(self.limit)
        self._words.trim(self.limit // 2)
        return out, bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class LibraryEncoder(PieceEncoder):
    """As ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self._shown = dict(enumerate(byte_alphabet()))
        self._marks = [x.content[:2] for x in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pretokens go to the library's model one by one."""
        tokenize = self.tokenizer.model.tokenize
        got = [[x.id for x in tokenize(w)] for w in self._alphabet(words)]
        sizes = np.fromiter(map(len, got), "i8", len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(sizes.sum())), sizes

    def _alphabet(self, words: list[str]) -> list[str]:
        """Settled words as strings of the byte alphabet; words hold no separator control."""
        joined = _BETWEEN.join(words)
        to = {c: c.encode().decode("latin-1").translate(self._shown) for c in set(joined) - _SHOWN_AS_IS}
        if to.keys() & set("".join(to.values())):  # one replacement would change what another has put
            return [w.encode().decode("latin-1").translate(self._shown) for w in words]
        for c, shown in to.items():
            joined = joined.replace(c, shown)
        return joined.split(_BETWEEN)

    def encode_odd(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def id_width(path: str, end_id: int) -> int:
    """Bytes an id: 2 if the tokenizer's largest id and end_id fit, else 4; larger or negative ids raise."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    if end_id < 0 or most >= 1 << 32:
        raise ValueError(f"ids of {path} with end id {end_id} do not fit in 32 bits")
    return 2 if most < 1 << 16 else 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at a task's end, since the worker stays."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, with the empty one for null."""
    return [t or "" for t in batch.column(column).to_pylist()]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's, and their bounds."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


def binary_runs(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose values are the bytes of the runs of flat between the bounds."""
    at = (bounds * flat.itemsize).astype("<i8")
    large = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])
    return large.cast(pa.binary())
