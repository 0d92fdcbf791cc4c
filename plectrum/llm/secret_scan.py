"""Secrets in texts and in whatever the texts wrap: a worklist of decoded layers, rescanned one by one.

A text is the first layer.  Each layer is scanned for secrets, then every decoder opens it: percent escapes and
Unicode escapes give one layer with the escapes replaced, each run of base64 gives a layer for every readable
stretch of its bytes and for every compressed stream in them.  New layers go on the worklist until none is new.
A layer carries, for each of its characters, the span of the text it was decoded from, so a finding in any layer
names a span of the text.

Spark deals the rows; nothing is shuffled, and a text is worked on where it was read.  Texts without a trigger
(most) are passed over by one regular expression a batch.

Edge cases: a null text is empty; an empty text has no secrets; equal rows get equal spans; ties between kinds
at one start go in the order of ``KINDS``; columns of any name are carried, and a result column that clashes is
named with leading underscores; a decoder that gives a layer of its own chain again (a stream that unpacks to
itself) ends there.  Streams that together unpack to more than ``ROOM`` bytes in one text are left and counted in
``n_unopened``: the only bound, which guards workers against streams made to fill memory.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plectrum.llm import common

#: The kinds, in the order of the contract: pattern, group whose length counts, least length.  (fixed values)
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: A run that is long enough, so that the scan for hex does not stop at every letter.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

#: Whether a text needs a scan at all, for a whole batch at once.
TRIGGER = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|&(?:amp;)*#|[A-Za-z0-9+/_-]{16}"

#: Bytes that the compressed streams of one text may unpack to, together.
ROOM = 16 << 20

Span = tuple[str, int, int]


class Layer:
    """A decoded text: ``start[i]``, ``end[i]`` is the span of the whole text that character i came from; None: itself."""

    __slots__ = ("text", "start", "end", "path", "chain")

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, path: str = "", chain: frozenset = frozenset()) -> None:
        self.text, self.start, self.end, self.path = text, start, end, path
        self.chain = chain | {self.digest()}

    def digest(self) -> bytes:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The span of the whole text behind the characters a to b."""
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        return self.start, self.end

    def child(self, text: str, first: np.ndarray, last: np.ndarray, name: str) -> Layer:
        """A layer whose character i stands for this layer's characters first[i] to last[i], both included."""
        start, end = self.places()
        return Layer(text, taken(start, first), taken(end, last), f"{self.path}>{name}" if self.path else name, self.chain)

    def mark(self) -> tuple[bytes, bytes]:
        """Equal for equal texts from equal places."""
        place = self.start[:1] if not self.start.strides[0] else self.start
        return self.digest(), hashlib.blake2b(place.tobytes(), digest_size=16).digest()


def constant(value: int, n: int) -> np.ndarray:
    """n times the value, held once: all that a stream unpacks to stands for the whole stream."""
    return np.broadcast_to(np.int64(value), (n,))


def taken(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(at) and not at.strides[0]:
        return constant(places[at[0]], len(at))
    return constant(places[0], len(at)) if len(places) and not places.strides[0] else places[at]


def found(text: str) -> Iterator[Span]:
    """The secrets of one layer, leftmost and non-overlapping within each kind."""
    if _KEYWORD.search(text):
        pattern, group, least = KINDS["assign"]
        yield from (("assign", *m.span()) for m in pattern.finditer(text) if len(m.group(group)) >= least)
    if "AKIA" in text:
        pattern, group, least = KINDS["access"]
        yield from (("access", *m.span()) for m in pattern.finditer(text) if len(m.group(group)) >= least)
    yield from (("hex", *m.span()) for m in _LONG_HEX.finditer(text))


# --- decoders: a layer and the room left in, its layers out -------------------------------------------


class Room:
    """Bytes that streams may still unpack to; ``refused`` counts the streams left."""

    def __init__(self, n: int) -> None:
        self.left, self.refused = n, 0


def _replaced(layer: Layer, pattern: re.Pattern, plain: Callable[[re.Match], tuple[str, np.ndarray, np.ndarray] | None], name: str) -> Iterator[Layer]:
    """The layer with every match replaced; plain gives the new characters and their places, relative to the match."""
    parts, firsts, lasts, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        new = plain(m)
        if new is None:
            continue
        a, b = m.span()
        parts += [layer.text[at:a], new[0]]
        kept = np.arange(at, a)
        firsts += [kept, new[1] + a]
        lasts += [kept, new[2] + a]
        at = b
    if parts:
        kept = np.arange(at, len(layer.text))
        yield layer.child("".join(parts) + layer.text[at:], np.concatenate([*firsts, kept]), np.concatenate([*lasts, kept]), name)


#: A percent sign may itself be escaped any number of times: the nest is opened at once, so depth costs nothing.
_ESCAPED = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
_PERCENT = re.compile(rf"(?:{_ESCAPED.pattern})+")


_LATIN = {0xDC00 + i: chr(i) for i in range(0x80, 0x100)}


def _text_of(data: bytes) -> tuple[str, np.ndarray]:
    """Bytes as UTF-8, bytes that are none as Latin-1, and the byte at which each character starts."""
    text = data.decode(errors="surrogateescape")
    if text.isascii():
        return text, np.arange(len(text))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    bad = (code >= 0xDC80) & (code <= 0xDCFF)
    size = np.where(bad, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).astype("i8")
    return text.translate(_LATIN) if bad.any() else text, np.cumsum(size) - size


def percent(layer: Layer, room: Room) -> Iterator[Layer]:
    def plain(m: re.Match):
        units = [(e.start(), e.end()) for e in _ESCAPED.finditer(m.group())]
        data = bytes(int(m.group()[b - 2 : b], 16) for _, b in units)
        text, at = _text_of(data)
        stop = np.append(at[1:], len(data)) - 1
        spans = np.array(units)
        return text, spans[at, 0], spans[stop, 1] - 1

    if "%" in layer.text:
        yield from _replaced(layer, _PERCENT, plain, "url")


_BACKSLASH = r"\\(?:u005[cC])*"
_UNICODE = re.compile(
    rf"{_BACKSLASH}(?:u[dD][89abAB][0-9a-fA-F]{{2}}{_BACKSLASH}u[dD][c-fC-F][0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|u\{{[0-9a-fA-F]{{1,6}}\}}|U[0-9a-fA-F]{{8}}|x[0-9a-fA-F]{{2}})"
    r"|&(?:amp;)*#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
)
_PAIR = re.compile(r"u([dD][89abAB][0-9a-fA-F]{2})\\(?:u005[cC])*u([dD][c-fC-F][0-9a-fA-F]{2})$")


def unicode(layer: Layer, room: Room) -> Iterator[Layer]:
    def plain(m: re.Match):
        told = m.group()
        pair = _PAIR.search(told)
        if pair:
            code = 0x10000 + ((int(pair[1], 16) - 0xD800) << 10) + int(pair[2], 16) - 0xDC00
        elif told[0] == "&":
            digits = told[told.index("#") + 1 : -1]
            code = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
        else:
            code = int(re.search(r"[uUx]\{?([0-9a-fA-F]+)\}?$", told)[1], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return None
        return chr(code), np.array([0]), np.array([len(told) - 1])

    if "\\" in layer.text or "&" in layer.text:
        yield from _replaced(layer, _UNICODE, plain, "unicode")


def _stream(make: Callable[[], object]) -> Callable[[bytes, int], bytes | None]:
    def unpack(data: memoryview, most: int) -> bytes | None:
        """The unpacked bytes, None if this is no such stream or more than ``most`` bytes."""
        try:
            got = make().decompress(data, most + 1)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return None
        return got

    return unpack


def _zstd(data: memoryview, most: int) -> bytes | None:
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(data) as reader:
            return reader.read(most + 1)
    except zstandard.ZstdError:
        return None


#: How streams begin, and what unpacks them.
STREAMS = {
    "gzip": (re.compile(rb"\x1f\x8b\x08"), _stream(lambda: zlib.decompressobj(31))),
    "zlib": (re.compile(rb"\x78[\x01\x5e\x9c\xda]"), _stream(zlib.decompressobj)),
    "bzip2": (re.compile(rb"BZh[1-9]1AY&SY"), _stream(bz2.BZ2Decompressor)),
    "xz": (re.compile(rb"\xfd7zXZ\x00"), _stream(lzma.LZMADecompressor)),
    "zstd": (re.compile(rb"\x28\xb5\x2f\xfd"), _zstd),
}

_ALPHABET = r"[A-Za-z0-9+/_-]"
#: A run of base64, wrapped into lines of 60 and more or not.
_BASE64 = re.compile(rf"{_ALPHABET}{{60,}}(?:\r?\n{_ALPHABET}{{60,}})*\r?\n{_ALPHABET}+|{_ALPHABET}{{16,}}")
#: Readable stretches: ASCII without controls but white space, and bytes of other scripts.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]{8,}")
_STANDARD = bytes.maketrans(b"-_", b"+/")


def _layers_of(data: bytes, first: np.ndarray, last: np.ndarray, layer: Layer, name: str, room: Room, chain: frozenset) -> Iterator[Layer]:
    """The readable stretches of some bytes, and those of every stream found in them; byte i stands for first[i] to last[i]."""
    for m in _READABLE.finditer(data):
        text, at = _text_of(m.group())
        if len(text) >= 8:
            stop = np.append(at[1:], len(m.group())) - 1
            yield layer.child(text, taken(first, m.start() + at), taken(last, m.start() + stop), name)
    for kind, (magic, unpack) in STREAMS.items():
        for m in magic.finditer(data):
            got = unpack(memoryview(data)[m.start() :], room.left)
            if got is None or not got:
                continue
            mark = hashlib.blake2b(got, digest_size=16).digest()
            if mark in chain:
                continue
            if len(got) > room.left:
                room.refused += 1
                continue
            room.left -= len(got)
            whole = (constant(first[m.start() :].min(), len(got)), constant(last[m.start() :].max(), len(got)))
            yield from _layers_of(got, *whole, layer, f"{name}>{kind}", room, chain | {mark})


def base64_runs(layer: Layer, room: Room) -> Iterator[Layer]:
    """Every run is read from each of its first four characters, as what precedes it may be glued to it."""
    for m in _BASE64.finditer(layer.text):
        run = np.frombuffer(m.group().encode(), "u1")
        held = np.flatnonzero((run != 10) & (run != 13))
        signs = run[held].tobytes().translate(_STANDARD)
        for shift in range(4):
            n = len(signs) - shift
            n -= n % 4 == 1
            data = base64.b64decode(signs[shift : shift + n] + b"=" * (-n % 4))
            bit = 8 * np.arange(len(data))
            place = m.start() + held[shift:]
            yield from _layers_of(data, place[bit // 6], place[(bit + 7) // 6], layer, "base64", room, frozenset({hashlib.blake2b(data, digest_size=16).digest()}))


Decoder = Callable[[Layer, Room], Iterator[Layer]]
DECODERS: tuple[Decoder, ...] = (percent, unicode, base64_runs)


def scan_text(text: str, decoders: tuple[Decoder, ...] = DECODERS, room_bytes: int = ROOM) -> tuple[list[Span], list[tuple[str, int, int, str]], int]:
    """The text's own secrets, those of its layers alone (with the way to the layer), and the streams left unopened."""
    order = {kind: i for i, kind in enumerate(KINDS)}
    room = Room(room_bytes)
    base = sorted(found(text), key=lambda s: (s[1], order[s[0]]))
    held, more = set(base), {}
    work, seen = deque([Layer(text)]), set()
    while work:
        layer = work.popleft()
        for decode in decoders:
            for new in decode(layer, room):
                mark = new.mark()
                if mark in seen or mark[0] in layer.chain:
                    continue
                seen.add(mark)
                for kind, a, b in found(new.text):
                    span = (kind, *new.span(a, b))
                    if span not in held:
                        more.setdefault(span, new.path)
                work.append(new)
    extra = sorted(((*span, path) for span, path in more.items()), key=lambda s: (s[1], order[s[0]], s[2]))
    return base, extra, room.refused


SPANS = "array<struct<kind:string,start:long,end:long,layers:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))


def _scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    left = np.zeros(len(texts), "i8")
    for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, TRIGGER))):
        base, more, left[i] = scan_text(texts[int(i)].as_py())
        spans[i] = [dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in [*((*b, "") for b in base), *more]]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW), pa.array(left)], names=["_row", "_spans", "_left"])


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all), ``spans`` (own secrets first, then those of layers; ``layers`` tells the way, '' for own) and ``n_unopened``."""
    keep = df.columns if keep is None else keep
    carried = F.struct(*[F.col(c) for c in common.quoted(keep)])
    boxed = df.select(carried.alias("_row"), F.col(common.quoted([text])[0]).cast("string").alias("_text"))
    schema = StructType([boxed.schema["_row"], *StructType.fromDDL(f"_spans {SPANS}, _left long").fields])
    out = boxed.mapInArrow(lambda batches: map(_scan_batch, batches), schema)
    names = common.free_names(keep, "spans", "n_unopened")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], F.col("_spans").alias(names[0]), F.col("_left").alias(names[1]))


def redact(df: DataFrame, text: str = "text", mask: str = "*") -> DataFrame:
    """df with every character of a secret's span masked, spans of layers included."""
    scanned = scan(df, text)
    spans = scanned.columns[-2]

    def masked(acc: Column, s: Column) -> Column:
        length = (s["end"] - s["start"]).cast("int")
        return F.overlay(acc, F.repeat(F.lit(mask), length), (s["start"] + 1).cast("int"), length)

    name = common.quoted([text])[0]
    hidden = F.aggregate(F.col(common.quoted([spans])[0]), F.col(name), masked)
    return scanned.select(*[(hidden.alias(c) if c == text else F.col(common.quoted([c])[0])) for c in df.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.documents(spark, sf_dir), keep=["doc_id"])
    own = F.filter("spans", lambda s: s["layers"] == "")
    rank = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair])
    ordered = F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    count = lambda kind: F.size(F.filter("own", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", own.alias("own"), ordered.alias("spans"), "n_unopened").select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(_joined(F.col("own")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("own")).cast("long").alias("n_decoded"),
        "n_unopened",
    )
