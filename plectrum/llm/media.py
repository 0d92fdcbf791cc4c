"""Media columns: ISO media containers walked box by box, without decoding their payload.

:func:`mux` stores a payload losslessly as 8-bit PCM samples of one audio track: frames of 576
samples, one of every ``SYNC_EVERY`` a sync sample, sample tables in ``moov`` after ``mdat``.
:func:`probe` walks the nested boxes of any such file, decodes stts, stsc, stsz/stz2, stco/co64 and stss, edit lists, and the
fragments of moof (tfhd, trun, with the defaults of trex), and gives codec, duration and the byte range of every keyframe; payload bytes are only located.

Edge cases: a null text is empty; an empty text is one frame of padding; boxes of 64-bit size, boxes
reaching to the end of the file, unknown boxes and absent optional tables (stss: every sample is a keyframe) are
read; a truncated or inconsistent container raises ValueError; repeated rows give equal rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.llm.common import documents
from plectrum.llm.tokens import text_slices

FRAME, RATE, SYNC_EVERY = 576, 8000, 16

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex")


def _box(kind: bytes, *body: bytes) -> bytes:
    inner = b"".join(body)
    if len(inner) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(inner) + 16) + inner
    return struct.pack(">I4s", len(inner) + 8, kind) + inner


def _full(kind: bytes, *body: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """An ISO media file that holds the payload, a positive multiple of FRAME bytes, as samples."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of the frame size")
    frames, duration = len(payload) // FRAME, len(payload)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    data = _box(b"mdat", payload)
    first = len(ftyp) + len(data) - len(payload)
    syncs = np.arange(1, frames + 1, SYNC_EVERY, dtype=">u4")
    # each 64 frames are a chunk, so that the tables have more than one row
    chunk = 64
    chunks = -(-frames // chunk)
    runs = [(1, chunk, 1)] if frames % chunk == 0 else ([(1, chunk, 1)] if chunks > 1 else []) + [(chunks, frames % chunk, 1)]
    places = first + np.arange(chunks, dtype="u8") * (chunk * FRAME)
    far = int(places[-1]) >= 1 << 32
    entry = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
        _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
        _full(b"stss", struct.pack(">I", len(syncs)), syncs.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if far else b"stco", struct.pack(">I", chunks), places.astype(">u8" if far else ">u4").tobytes()),
    )
    v = int(duration >= 1 << 32)
    span = struct.pack(">Q" if v else ">I", duration)
    zero = bytes(16 if v else 8)
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(
        b"mdia",
        _full(b"mdhd", zero, struct.pack(">I", RATE), span, struct.pack(">HH", 0x55C4, 0), version=v),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
        minf,
    )
    tkhd = _full(b"tkhd", zero, struct.pack(">II", 1, 0), span, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3, version=v)
    mvhd = _full(b"mvhd", zero, struct.pack(">I", RATE), span, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=v)
    return ftyp + data + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 1
    duration: int = 0
    offsets: np.ndarray | None = None  # of each sample
    sizes: np.ndarray | None = None
    syncs: np.ndarray | None = None  # 0-based samples
    number: int = 0
    edits: tuple[tuple[int, int], ...] = ()  # (duration of the presentation, start in the media or -1)

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale


def _walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, body start and body end of each box between at and end."""
    while at < end:
        if end - at < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, body, at + size
        at += size


def _table(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    """Rows after a 32-bit count."""
    (n,) = struct.unpack_from(">I", data, at)
    if at + 4 + n * columns * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * columns, at + 4).astype("i8").reshape(n, columns)


def _edits(data: memoryview, a: int, b: int) -> np.ndarray:
    """The edit list's rows: duration (d), start in the media (t) and rate (r)."""
    kind = np.dtype([("d", ">u8"), ("t", ">i8"), ("r", ">u4")] if data[a] == 1 else [("d", ">u4"), ("t", ">i4"), ("r", ">u4")])
    (n,) = struct.unpack_from(">I", data, a + 4)
    if a + 8 + n * kind.itemsize > b:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n, a + 8)


def _compact(data: memoryview, a: int, b: int) -> np.ndarray:
    """Sizes of 4, 8 or 16 bits each."""
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
        raise ValueError("a sample table is cut off")
    if bits == 4:
        pairs = np.frombuffer(data, "u1", (n + 1) // 2, a + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n].astype("i8")
    return np.frombuffer(data, ">u2" if bits == 16 else "u1", n, a + 12).astype("i8")


#: Flags of fragment headers and runs: a field is there (fixed values of the format).
_TFHD = ((0x1, "base", ">Q"), (0x2, "description", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I"))
_TRUN = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
_NO_SYNC = 0x10000


def _fragment(data: memoryview, at: int, a: int, b: int, tracks: dict[int, Track], defaults: dict[int, dict[str, int]]) -> None:
    """The samples of a movie fragment, which starts at ``at``, go to the ends of their tracks."""
    previous = at  # where the data of the run before ended, for runs that name no place
    for kind, low, high in _walk(data, a, b):
        if kind != b"traf":
            continue
        head: dict[str, int] = {}
        track, base, following = None, previous, None
        for inner, x, y in _walk(data, low, high):
            flags = struct.unpack_from(">I", data, x)[0] & 0xFFFFFF
            if inner == b"tfhd":
                number, place = struct.unpack_from(">I", data, x + 4)[0], x + 8
                track, head = tracks.get(number), dict(defaults.get(number, {}))
                for flag, name, form in _TFHD:
                    if flags & flag:
                        head[name] = struct.unpack_from(form, data, place)[0]
                        place += struct.calcsize(form)
                base = head.get("base", at if flags & 0x20000 else previous)
            elif inner == b"trun" and track is not None:
                n, place = struct.unpack_from(">I", data, x + 4)[0], x + 8
                start = base if following is None else following
                if flags & 0x1:
                    start = base + struct.unpack_from(">i", data, place)[0]
                    place += 4
                first = None
                if flags & 0x4:
                    first = struct.unpack_from(">I", data, place)[0]
                    place += 4
                there = [name for flag, name in _TRUN if flags & flag]
                if place + 4 * n * len(there) > y:
                    raise ValueError("a sample table is cut off")
                rows = np.frombuffer(data, ">u4", n * len(there), place).astype("i8").reshape(n, len(there))
                told = {name: rows[:, i] if (i := there.index(name) if name in there else -1) >= 0 else np.full(n, head.get(name, 0), "i8") for name in ("duration", "size", "flags")}
                if first is not None and n:
                    told["flags"] = np.append(first, told["flags"][1:])
                upto = np.cumsum(told["size"])
                held = len(track.sizes)
                track.offsets = np.append(track.offsets, start + upto - told["size"])
                track.sizes = np.append(track.sizes, told["size"])
                track.syncs = np.append(track.syncs, held + np.flatnonzero(told["flags"] & _NO_SYNC == 0))
                track.duration += int(told["duration"].sum())
                following = previous = start + int(upto[-1]) if n else start


def probe(file: bytes) -> list[Track]:
    """The tracks of a container, from its boxes alone."""
    data, tracks = memoryview(file), []
    defaults: dict[int, dict[str, int]] = {}

    def descend(at: int, end: int, track: Track | None, tables: dict[bytes, np.ndarray]) -> None:
        for kind, a, b in _walk(data, at, end):
            if kind == b"trak":
                own, found = Track(), {}
                descend(a, b, own, found)
                _place(own, found)
                tracks.append(own)
            elif kind in CONTAINERS:
                descend(a, b, track, tables)
            elif kind == b"trex":
                number, _, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = {"duration": duration, "size": size, "flags": flags}
            elif track is None:
                continue
            elif kind == b"mdhd":
                wide = data[a] == 1
                track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif kind == b"tkhd":
                (track.number,) = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))
            elif kind == b"elst":
                track.edits = tuple((int(r["d"]), int(r["t"])) for r in _edits(data, a, b))
            elif kind == b"stz2":
                tables[b"stsz"] = _compact(data, a, b)
            elif kind == b"hdlr":
                track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                track.codec = next((k.decode("latin-1") for k, _, _ in _walk(data, a + 8, b)), "")
            elif kind == b"stsz":
                fixed, n = struct.unpack_from(">II", data, a + 4)
                tables[kind] = np.full(n, fixed, "i8") if fixed else _table(data, a + 8, b, ">u4")[:, 0]
            elif kind in (b"stts", b"stsc"):
                tables[kind] = _table(data, a + 4, b, ">u4", 2 if kind == b"stts" else 3)
            elif kind in (b"stco", b"co64"):
                tables[b"chunks"] = _table(data, a + 4, b, ">u4" if kind == b"stco" else ">u8")[:, 0]
            elif kind == b"stss":
                tables[kind] = _table(data, a + 4, b, ">u4")[:, 0] - 1

    descend(0, len(data), None, {})
    numbered, at = {t.number: t for t in tracks}, 0
    for kind, a, b in _walk(data, 0, len(data)):
        if kind == b"moof":
            _fragment(data, at, a, b, numbered, defaults)
        at = b
    return tracks


def _place(track: Track, tables: dict[bytes, np.ndarray]) -> None:
    """Where each sample lies: chunk offsets plus the sizes before it in its chunk."""
    sizes, chunks = tables.get(b"stsz", np.zeros(0, "i8")), tables.get(b"chunks", np.zeros(0, "i8"))
    runs = tables.get(b"stsc", np.zeros((0, 3), "i8"))
    if len(runs):
        upto = np.append(runs[1:, 0] - 1, len(chunks))
        per_chunk = np.repeat(runs[:, 1], upto - runs[:, 0] + 1)
    else:
        per_chunk = np.zeros(0, "i8")
    if len(per_chunk) != len(chunks) or per_chunk.sum() != len(sizes):
        raise ValueError("the sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    held = per_chunk > 0
    track.offsets = np.repeat(chunks[held], per_chunk[held]) + before - np.repeat(before[first[held]], per_chunk[held])
    track.sizes = sizes
    track.syncs = tables.get(b"stss", np.arange(len(sizes)))


def payload_of(file: bytes, track: Track) -> bytes:
    """The track's samples read back in order; adjacent samples are one read."""
    if not len(track.sizes):
        return b""
    cuts = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    starts = track.offsets[np.concatenate([[0], cuts])]
    ends = (track.offsets + track.sizes)[np.concatenate([cuts - 1, [len(track.sizes) - 1]])]
    return b"".join(file[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def containers(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, each text's container as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            sizes, files = [len(t or b"") for t in raw], [mux(padded(t)) for t in raw]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(files, pa.binary())})

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def padded(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<offset:long,length:long>>"
)


def features(df: DataFrame) -> DataFrame:
    """Each text stored as a container, then everything read from the stored bytes."""
    return read_back(containers(df))


def read_back(media: DataFrame) -> DataFrame:
    """Codec, duration, keyframe ranges and digests of a media column (doc_id, n_bytes, media), from its bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in text_slices(batches, "media"):
            rows = []
            for doc, n_bytes, file in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                track = probe(file)[0]
                back = payload_of(file, track)
                at, size = track.offsets[track.syncs], track.sizes[track.syncs]
                listed = np.stack([at, size]).astype("<i8").tobytes()
                feature = f"{track.handler}/{track.codec}/{track.timescale} {track.duration} samples={len(track.sizes)} keyframes={len(at)} ranges={zlib.crc32(listed):08x}"
                rows.append(
                    {
                        "doc_id": doc,
                        "n_bytes": n_bytes,
                        "payload_bytes": len(back),
                        "payload_sha256": hashlib.sha256(back).hexdigest(),
                        "tail_crc32": zlib.crc32(back[-32:]),
                        "media_bytes": len(file),
                        "media_sha256": hashlib.sha256(file).hexdigest(),
                        "feature": feature,
                        "codec": track.codec,
                        "seconds": track.seconds,
                        "keyframes": [{"offset": a, "length": n} for a, n in zip(at.tolist(), size.tolist(), strict=True)],
                    }
                )
            columns = {k: [r[k] for r in rows] for k in rows[0]}
            columns["keyframes"] = pa.array(columns["keyframes"], ranges_type)
            columns["doc_id"] = pa.array(columns["doc_id"], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(documents(spark, sf_dir))
