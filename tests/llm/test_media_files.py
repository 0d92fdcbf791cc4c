"""Containers written by hand, box by box: other orders, table forms and fragments than those the operator writes."""

import struct

import pytest

from plectrum.llm import media


def box(kind, *body, wide=False):
    inner = b"".join(body)
    return struct.pack(">I4sQ", 1, kind, len(inner) + 16) + inner if wide else struct.pack(">I4s", len(inner) + 8, kind) + inner


def full(kind, *body, version=0, flags=0, wide=False):
    return box(kind, struct.pack(">I", version << 24 | flags), *body, wide=wide)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def track(number, codec, tables, version=0, timescale=90000, duration=0, edits=b""):
    times = struct.pack(">QQ", 0, 0) if version else u32(0, 0)
    length = struct.pack(">Q", duration) if version else u32(duration)
    tkhd = full(b"tkhd", times, u32(number, 0), length, bytes(60), version=version)
    mdhd = full(b"mdhd", times, u32(timescale), length, u32(0), version=version)
    stsd = full(b"stsd", u32(1), box(codec, bytes(20)))
    stbl = box(b"stbl", stsd, *tables)
    return box(b"trak", tkhd, edits, box(b"mdia", mdhd, full(b"hdlr", u32(0), b"vide", bytes(13)), box(b"minf", box(b"free", b"x"), stbl)))


def test_tables_of_64_bits_and_compact_sizes_in_a_file_that_begins_with_its_index():
    sizes = [3, 7, 1, 15, 2]
    tables = lambda at: (
        full(b"stts", u32(1, 5, 10)), full(b"stsc", u32(2, 1, 2, 1, 3, 1, 1)), full(b"stz2", bytes(3), b"\x04", u32(5), bytes([0x37, 0x1F, 0x20])),
        full(b"co64", u32(3), struct.pack(">3Q", at, at + 50, at + 80)), full(b"stss", u32(2, 1, 4)),
    )
    edits = box(b"edts", full(b"elst", u32(2), struct.pack(">QqI", 100, -1, 0x10000), struct.pack(">QqI", 50, 7, 0x10000), version=1))
    build = lambda at: box(b"ftyp", b"mp42", u32(0)) + box(b"moov", box(b"udta", box(b"name", b"n")), track(3, b"avc1", tables(at), 1, 600, 50, edits))
    at = len(build(0)) + 16
    data = bytes(range(100))
    file = build(at) + box(b"mdat", data, wide=True)
    (t,) = media.probe(file)
    assert (t.number, t.handler, t.codec, t.timescale, t.duration, t.edits) == (3, "vide", "avc1", 600, 50, ((100, -1), (50, 7)))
    assert t.sizes.tolist() == sizes and (t.offsets - at).tolist() == [0, 3, 50, 51, 80] and t.syncs.tolist() == [0, 3]
    assert media.payload_of(file, t) == data[:10] + data[50:66] + data[80:82]


@pytest.mark.parametrize(("bits", "raw"), [(8, bytes([5, 6, 7])), (16, struct.pack(">3H", 5, 6, 7)), (4, bytes([0x56, 0x70]))])
def test_compact_sizes(bits, raw):
    tables = (full(b"stts", u32(0)), full(b"stsc", u32(1, 1, 3, 1)), full(b"stz2", bytes(3), bytes([bits]), u32(3), raw), full(b"stco", u32(1, 0)))
    (t,) = media.probe(box(b"moov", track(1, b"mp4a", tables)))
    assert t.sizes.tolist() == [5, 6, 7] and t.syncs.tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="cut off"):
        media.probe(box(b"moov", track(1, b"mp4a", (full(b"stz2", bytes(3), bytes([bits]), u32(300), raw),))))


EMPTY = (full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0)))


def test_fragments_take_their_defaults_from_header_and_movie():
    moov = box(b"moov", track(1, b"avc1", EMPTY), track(2, b"mp4a", EMPTY), box(b"mvex", full(b"trex", u32(1, 1, 100, 9, 0x10000)), full(b"trex", u32(2, 1, 20, 4, 0))))

    def moof(at):
        one = box(b"traf", full(b"tfhd", u32(1), flags=0x20000), full(b"trun", u32(3), struct.pack(">i", at), u32(0), u32(5, 6, 7), flags=0x205))
        two = box(b"traf", full(b"tfhd", u32(2), u32(30), flags=0x20008), full(b"trun", u32(2), struct.pack(">i", at + 18), flags=0x1), full(b"trun", u32(1), u32(11, 8, 0x10000), flags=0x700))
        return box(b"moof", full(b"mfhd", u32(1)), one, two)

    head = len(moof(0))
    data = bytes(range(40))
    first = moov + moof(head + 8) + box(b"mdat", data)
    again = box(b"moof", full(b"mfhd", u32(2)), box(b"traf", full(b"tfhd", u32(1), struct.pack(">Q", len(first) + 200), flags=0x1), full(b"trun", u32(2), flags=0)))
    file = first + again + box(b"free", bytes(400))
    video, sound = media.probe(file)
    base = len(moov) + head + 8
    assert (video.offsets - base).tolist()[:3] == [0, 5, 11] and video.sizes.tolist() == [5, 6, 7, 9, 9] and video.syncs.tolist() == [0]
    assert video.offsets.tolist()[3:] == [len(first) + 200, len(first) + 209] and video.duration == 500
    assert (sound.offsets - base).tolist() == [18, 22, 26] and sound.sizes.tolist() == [4, 4, 8] and sound.syncs.tolist() == [0, 1] and sound.duration == 71
    assert media.payload_of(file, video)[:18] == data[:18] and media.payload_of(file, sound) == data[18:34]


def test_fragments_of_unknown_tracks_and_cut_runs():
    lost = box(b"moof", box(b"traf", full(b"tfhd", u32(7)), full(b"trun", u32(2), flags=0)))
    (t,) = media.probe(box(b"moov", track(1, b"avc1", EMPTY)) + lost)
    assert len(t.sizes) == 0 and t.duration == 0
    cut = box(b"moof", box(b"traf", full(b"tfhd", u32(1)), full(b"trun", u32(5), u32(1), flags=0x200)))
    with pytest.raises(ValueError, match="cut off"):
        media.probe(box(b"moov", track(1, b"avc1", EMPTY)) + cut)
