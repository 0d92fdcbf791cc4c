"""Words of whole Arrow batches as hashes, computed over the UTF-8 bytes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: An odd base; base - 1 has one factor of two, so that swapped bytes change the hash.
_BASE = _U(0x9E3779B97F4A7C17)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: A random value for each byte.
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype="u8")

#: Bytes that separate words by white space: the space and the ASCII line and tab controls.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of letters: ASCII letters and all of other scripts.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype="u1")
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1)."""
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, "u8")
        got[0] = 1
        _powers[name] = got = np.cumprod(got, dtype="u8")
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of the texts of a column: byte spans, owners and a hash of any span.

    A word is a run of bytes for which ``inside`` holds, within one text; null texts have none.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray, fold: np.ndarray = LOWER) -> None:
        flat = pc.fill_null(column, "").cast(pa.large_binary())
        self.n = n = len(flat)
        offsets = np.frombuffer(flat.buffers()[1], "<i8", n + 1, flat.offset * 8) if n else np.zeros(1, "i8")
        data = np.frombuffer(flat.buffers()[2], "u1")[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, "u1")
        offsets = offsets - offsets[0]
        word = inside[data]
        first = word.copy()  # whether a word starts here
        first[1:] &= ~word[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = word[edges]
        last = word.copy()
        last[:-1] &= ~word[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = word[ends]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.cuts = np.searchsorted(self.starts, offsets)  # words before each text
        self.owner = np.repeat(np.arange(n), np.diff(self.cuts))
        self._sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(_VALUES[fold[data]] * _power("up", _BASE, len(data)), out=self._sums[1:])
        self._down = _power("down", _INVERSE, len(data) + 1)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        raw = (self._sums[ends] - self._sums[self.starts]) * self._down[self.starts]
        return mixed(raw + (ends - self.starts).astype("u8") * _U(0xD6E8FEB86659FD93))

    def shingles(self, k: int = 3) -> list[np.ndarray]:
        """Each text's sorted distinct hashes of k words in a row; fewer words count as one."""
        return [np.unique(x) for x in self.shingle_runs(k)]

    def shingle_runs(self, k: int = 3) -> list[np.ndarray]:
        """Each text's hashes of k words in a row, in order, repeats included."""
        h = self.hashes()
        rolled = np.zeros(max(0, len(h) - k + 1), "u8")
        for i in range(k):
            rolled = mixed(rolled * _U(3) + h[i : i + len(rolled)])
        out, cuts = [], self.cuts.tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a >= k:
                out.append(rolled[a : b - k + 1])
            elif b > a:
                one = np.array([b - a], "u8")
                for i in range(a, b):
                    one = mixed(one * _U(5) + h[i] + _U(1))
                out.append(one)
            else:
                out.append(h[:0])
        return out
