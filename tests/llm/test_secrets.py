"""Secrets against a brute-force scan, wrapped secrets against their places, and texts that could trip the worklist."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, odd_rows

from plectrum.llm import secret_scan as s

SECRET = "password=hunter2hunter2"


def brute(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def texts():
    rng = random.Random(5)
    parts = ["password", "PASSWD", "Secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "AB12", "x.y-z", "é🙂", "\n", "K", "K"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(400)] + [t[1] or "" for t in odd_rows()]


def test_own_secrets_against_brute_force(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())] + [(9999, None, "en", "s", 1), (9999, None, "en", "s", 1)]
    got = s.scan(spark.createDataFrame(rows, DOCS).repartition(3), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    own = {r["doc_id"]: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["spans"] if not x["layers"]) for r in got}
    assert own == {r[0]: brute(r[1] or "") for r in rows} and sum(map(bool, own.values())) > 100


def test_query(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts()[:200])] + [(7777, None, "en", "s", 1), (7778, f"é {b64(SECRET)} {SECRET}", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in s.query(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        want = brute(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [len(re.findall(rf"{k}:", want)) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    n = len(b64(SECRET))  # one sign of padding, which holds nothing
    assert got[7778]["spans"] == f"assign:2:{1 + n},assign:{3 + n}:{3 + n + len(SECRET)}" and got[7778]["n_decoded"] == 1
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert s.query(spark, f"{tmp_path}/none").count() == 0


def whole(text):
    return "".join(f"%{b:02X}" for b in text.encode())


WRAPS = {
    "url": whole,
    "quoted": urllib.parse.quote,
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
    "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "entity16": lambda t: "".join(f"&#x{ord(c):X};" for c in t),
    "bytes": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "base64": b64,
    "url-safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
    "bzip2": lambda t: b64(bz2.compress(t.encode())),
    "xz": lambda t: b64(lzma.compress(t.encode())),
    "gzip of zlib": lambda t: b64(gzip.compress(zlib.compress(t.encode()))),
    "wrapped": lambda t: base64.encodebytes((t + " " * 90).encode()).decode().strip(),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", [None, *WRAPS])
def test_wrapped_secrets_are_mapped_to_the_wrapper(outer, inner):
    plain = f"note {SECRET} end"
    told = WRAPS[outer](WRAPS[inner](plain) if inner else plain)
    text = f"é🙂 before. {told} after"
    a = text.index(told)
    base, more, left = s.scan_text(text)
    if SECRET in told:  # quoted once or not at all leaves a part readable
        return
    spans = [x for x in [*base, *more] if x[0] == "assign"]
    assert spans and left == 0, (outer, inner, told)
    assert all(a <= x[1] < x[2] <= a + len(told) for x in spans)


def test_places_are_exact():
    text = "ab " + whole(SECRET) + " cd"
    (_, a, b, path), *rest = s.scan_text(text)[1]
    assert (a, b, path, rest) == (3, 3 + 3 * len(SECRET), "url", [])
    inner = b64("xyz" + SECRET + "; end")  # three bytes are four signs: the secret starts at a sign of its own
    (_, a, b, path), *rest = s.scan_text("\n" + inner)[1]
    assert (a, path, rest) == (5, "base64", []) and inner[a - 1 : b - 1] in inner and base64.b64decode(inner[4 : b - 1] + "=" * (-(b - 5) % 4))[: len(SECRET)] == SECRET.encode()
    half = "pass" + whole("word=abc") + "defgh1 x"
    assert [x[:3] for x in s.scan_text(half)[1]] == [("assign", 0, len(half) - 2)]
    assert [x[:3] for x in s.scan_text("é%E2%82%AC" + half)[1]] == [("assign", 10, 10 + len(half) - 2)]


def test_glued_and_repeated_runs():
    for glue in ("", "a", "ab/", "abc-"):
        assert [x[0] for x in s.scan_text(f"data {glue}{b64('some words, ' + SECRET)}")[1]].count("assign") >= 1
    twice = f"{b64(SECRET)} {b64(SECRET)}"
    assert len(s.scan_text(twice)[1]) == 2  # equal layers at two places


def test_deep_nests_end():
    text = SECRET
    for _ in range(12):
        text = b64(text)
    (kind, a, b, path), *_ = s.scan_text(text)[1]
    assert (kind, a, path.count("base64")) == ("assign", 0, 12) and 0.9 * len(text) < b <= len(text)  # padding ends the levels early
    deep = "%" + "25" * 200_000 + "3D"
    assert [x[:3] for x in s.scan_text(f"password{deep}abcdefgh")[1]] == [("assign", 0, 8 + len(deep) + 8)]
    deep = "\\" + "u005c" * 100_000 + "u003d"
    assert [x[:3] for x in s.scan_text(f"password{deep}abcdefgh")[1]] == [("assign", 0, 8 + len(deep) + 8)]


def test_cycles_end():
    """Two decoders that undo each other, and a stream that unpacks to itself."""

    def turned(layer, room):
        import numpy as np

        at = np.arange(len(layer.text))
        yield layer.child(layer.text[::-1], at[::-1].copy(), at[::-1].copy(), "turned")

    base, more, _ = s.scan_text("8hgfedcba=drowssap", decoders=(turned,))
    assert (base, [x[:3] for x in more]) == ([], [("assign", 0, 18)])
    room = s.Room(1 << 20)
    selfish = {"self": (re.compile(b"SELF"), lambda data, most: bytes(data))}
    held, s.STREAMS = s.STREAMS, selfish
    try:
        assert len(list(s.base64_runs(s.Layer(b64(b"SELF and the rest of it")), room))) < 10
    finally:
        s.STREAMS = held


def test_streams_that_unpack_to_too_much_are_counted():
    bomb = b64(gzip.compress(b" " * 3_000_000 + SECRET.encode()))
    assert s.scan_text(bomb, room_bytes=1 << 20)[1:] == ([], 1)
    assert [x[:3] for x in s.scan_text(bomb)[1]] == [("assign", 0, len(bomb.rstrip("=")))] and s.scan_text(bomb)[2] == 0


def test_random_bytes_find_nothing():
    rng = random.Random(8)
    for n in (40, 400, 200_000):
        assert s.scan_text(b64(rng.randbytes(n)))[1:] == ([], 0)
    assert s.scan_text("x" * 1_000_000)[1:] == ([], 0)


def test_columns_of_any_name_and_masks(spark):
    rows = [(1, f"a {SECRET} b", 5, "u", "dot"), (2, None, 6, "v", None), (3, f"é {b64(SECRET)}", 7, "w", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, `_spans` string, `a.b` string")
    got = s.scan(df)
    assert got.columns == [*df.columns, "__spans", "__n_unopened"] and [tuple(r)[:5] for r in got.orderBy("doc_id").collect()] == rows
    hidden = {r["doc_id"]: r["text"] for r in s.redact(df).collect()}
    assert hidden == {1: f"a {'*' * len(SECRET)} b", 2: None, 3: "é " + "*" * (len(b64(SECRET)) - 1) + "="}
    assert s.redact(df).columns == df.columns
    assert s.scan(df.select(F.col("text").alias("T x")), text="T x", keep=[]).columns == ["spans", "n_unopened"]
