"""Requests, player states, settings, frames, seeded numbers and sinks against known or brute-force results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plectrum import sinks
from plectrum.functions import requests
from plectrum.operators import evaluation, experiment, navigation


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("raw", "player", "flags", "error", "phase"),
    [
        ("empty", "idle", "0000", None, "empty"), ("ready", "playing", "0001", None, "exporting"), ("loading", "idle", "0000", "x", "loading"), ("ready", "playing", "0000", "x", "error"),
        ("ready", "playing", "1000", None, "playing"), ("ready", "ended", "1000", None, "ready"), ("ready", "paused", "0000", None, "paused"), ("ready", "idle", "1100", None, "preparing"),
        ("ready", "idle", "0100", None, "ready"), ("ready", "idle", "0110", None, "preparing"), ("ready", "idle", "0000", None, "preparing"), ("error", "idle", "0000", None, "ready"),
    ],
)
def test_reader_phase(spark, raw, player, flags, error, phase):
    bits = [F.lit(b == "1") for b in flags]
    assert one(spark, requests.reader_phase(F.lit(raw), F.lit(player), *bits, F.lit(error).cast("string"))) == (phase,)


def test_phases_have_closed_bounds(spark):
    ms = [5000, 5001, 20_000, 40_000, 40_001]
    assert one(spark, *[requests.phase_by_elapsed(F.lit(m)).alias(str(m)) for m in ms]) == ("queue", "connect", "connect", "first_byte", "stream")
    assert one(spark, requests.deadline(F.lit(59_999)), requests.deadline(F.lit(60_000))) == (None, "stream")


def test_frames(spark):
    meta = F.lit('{"mimeType":"audio/wav"}')
    whole = requests.frame(meta, meta, F.lit(b"\x00\x01"))
    back = spark.range(1).select(requests.parse_frame(whole).alias("p")).first()["p"]
    assert (back["problem"], back["metadata"], bytes(back["audio"])) == (None, '{"mimeType":"audio/wav"}', b"\x00\x01")
    long = F.concat(F.lit('{"boundaries":"'), F.repeat(F.lit("x"), F.lit(70_000)), F.lit('"}'))
    cut = spark.range(1).select(requests.parse_frame(requests.frame(long, F.lit("{}"), F.lit(b"a"))).alias("p")).first()["p"]
    assert (cut["metadata"], bytes(cut["audio"])) == ("{}", b"a")
    bad = {b"abc": "malformed_frame", b"\x00\x00\x00\x00x": "malformed_frame_metadata", b"\x09\x00\x00\x00{}": "truncated_frame", b"\x02\x00\x00\x00\xff\xfe": "malformed_frame_metadata"}
    for data, problem in bad.items():
        assert spark.range(1).select(requests.parse_frame(F.lit(data)).alias("p")).first()["p"]["problem"] == problem


def test_settings():
    assert requests.load_settings({}) == requests.Settings()
    got = requests.load_settings({"SPEECH_TIMEOUT_MS": "1000", "EDGE_TTS_ENABLED": "true", "CLOUD_API_KEY": ""})
    assert (got.speech_timeout_ms, got.edge_tts_enabled, got.cloud_api_key) == (1000, True, None)
    for env in ({"SPEECH_TIMEOUT_MS": "999"}, {"SPEECH_TIMEOUT_MS": "x"}, {"LOG_LEVEL": "loud"}, {"SPEECH_PROVIDER": "cloud"}, {"CLOUD_API_KEY": "short"}):
        with pytest.raises(ValueError):
            requests.load_settings(env)
    assert not requests.load_settings({"EDGE_TTS_ENABLED": "false"}).edge_tts_enabled


def test_provider_issues_and_engines(spark):
    settings = {"URL": F.lit("u"), "KEY": F.lit(None).cast("string"), "ID": F.lit("")}
    assert one(spark, requests.provider_issues(F.lit(True), settings))[0] == ["KEY is required when provider is enabled", "ID is required when provider is enabled"]
    assert one(spark, requests.provider_issues(F.lit(False), settings))[0] == []
    both = F.array(F.lit("default"), F.lit("edge"))
    pick = lambda c, la, a=both: requests.resolve_engine(F.lit(c), F.lit(la), a)
    assert one(spark, pick("auto", "es"), pick("auto", "en"), pick("default", "es"), pick("edge", "en", F.array(F.lit("default")))) == ("edge", "default", "default", "default")


# --- seeded numbers ---------------------------------------------------------------------------------


def numbers(seed):
    """The generator in plain 32-bit arithmetic."""
    m, a = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & m
        t = ((a ^ a >> 15) * (a | 1)) & m
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & m)) & m
        yield (t ^ t >> 14) / 4294967296


def test_seeded_numbers_and_shuffles(spark):
    for seed in (0, 7, 20260902, 0xFFFFFFFF, 0x9E3779B9):
        own = numbers(seed)
        want = [next(own) for _ in range(40)]
        got = [r["x"] for r in spark.range(40).select(F.col("id"), experiment.random_at(F.lit(seed), F.col("id")).alias("x")).orderBy("id").collect()]
        assert got == want
        draw, items = numbers(seed), list(range(9))
        for i in range(8, 0, -1):
            j = int(next(draw) * (i + 1))
            items[i], items[j] = items[j], items[i]
        assert one(spark, experiment.shuffled(F.array(*map(F.lit, range(9))), F.lit(seed)))[0] == items
    assert one(spark, experiment.shuffled(F.array(F.lit(3)), F.lit(1)))[0] == [3]


def test_sides_and_clips(spark):
    pairs = spark.createDataFrame([(e, p, f"lit {p}", f"gold text {p}") for e in (5, 6) for p in range(6)], "experiment long, pair long, literal_text string, gold_text string")
    sides = experiment.assign_sides(pairs, F.col("experiment")).cache()
    for e in (5, 6):
        rows = sorted((r for r in sides.collect() if r["experiment"] == e), key=lambda r: r["presentation_order"])
        draw = numbers(0x9E3779B9 ^ e)
        name = lambda draw=draw: "g3a-" + "".join(experiment.ALPHABET[int(next(draw) * 31)] for _ in range(8))
        assert sorted(r["pair"] for r in rows) == list(range(6))
        for r in rows:
            assert (r["left_condition"], r["left_clip"], r["right_clip"]) == ("gold" if next(draw) < 0.5 else "literal", name(), name())
    made = experiment.clips(sides, pairs)
    assert made.count() == 24 and made.where("(condition = 'gold') <> startswith(text, 'gold')").count() == 0
    assert {r["char_ratio"] for r in experiment.clip_balance(made).collect()} == {2.2}


def test_gold_pairs_need_their_blocks(spark):
    blocks = spark.createDataFrame([(1, "b1", "x"), (1, "b2", " same ")], "doc_id long, block_id string, text string")
    gold = lambda *rows: spark.createDataFrame(rows, "doc_id long, entry int, block_id string, gold_text string")
    assert [r["block_id"] for r in evaluation.gold_pairs(gold((1, 0, "b1", "y"), (1, 1, "b2", "same")), blocks).collect()] == ["b1"]
    with pytest.raises(Exception, match="unknown block"):
        evaluation.gold_pairs(gold((1, 0, "zz", "y")), blocks).collect()


# --- lookups and checks -----------------------------------------------------------------------------


def test_active_entry_takes_the_last_in_the_list(spark):
    rng = random.Random(4)
    toc = [(d, p, rng.randrange(12), f"{p}") for d in range(5) for p in range(6)]
    blocks = [(d, o) for d in range(6) for o in range(12)]
    got = navigation.active_entry(spark.createDataFrame(blocks, "doc_id long, ord long"), spark.createDataFrame(toc, "doc_id long, pos long, block_index long, label string")).collect()
    for r in got:
        fit = [t for t in toc if t[0] == r["doc_id"] and t[2] <= r["ord"]]
        assert r["label"] == (max(fit, key=lambda t: t[1])[3] if fit else None)
    assert len(got) == len(blocks)


def test_words_at_overlaps_and_ends(spark):
    words = spark.createDataFrame([(1, [(0, 100, "a"), (50, 20, "b"), (200, 10, "c")]), (2, [])], "by long, words array<struct<off_ms:int,dur_ms:int,word:string>>")
    points = spark.createDataFrame([(1, 0), (1, 60), (1, 100), (1, 205), (1, 210), (2, 5), (3, 5)], "by long, local_ms int")
    got = {(r["by"], r["local_ms"]): (r["active_word"], r["n_started"]) for r in navigation.words_at(points, words).collect()}
    assert got == {(1, 0): ("a", 1), (1, 60): ("a", 2), (1, 100): (None, 2), (1, 205): ("c", 3), (1, 210): (None, 3), (2, 5): (None, 0), (3, 5): (None, 0)}


def test_links_and_cut_labels(spark):
    hrefs = ["a%20b.xhtml#p1", "c+d", "epubcfi(/6/2)", "%zz"]
    got = [one(spark, navigation.clean_target(F.lit(h)))[0] for h in hrefs]
    assert got == ["a b.xhtml", "c+d", None, "%zz"]
    assert one(spark, navigation.head_units(F.lit("a😀b"), 2), navigation.head_units(F.lit("a😀b"), 3), navigation.head_units(F.lit("ab"), 5)) == ("a", "a😀", "ab")


def test_independent_check_of_segments(spark):
    kind = "doc_id long, segment_id string, source_text string, spoken_text string, transformations array<struct<rule:string,source:string,replacement:string>>, muted boolean, muted_by string, fallback boolean"
    rows = [
        (1, "s0", "No deberá pagar 42 €", "No deberá pagar cuarenta y dos euros", [("currencies", "42 €", "cuarenta y dos euros")], False, None, False),
        (1, "s1", "salvo que 7", "siempre 7 y 8", [], False, None, False), (2, "s0", "página 3", "", [], True, "layout-classification", False), (2, "s1", "queda prohibido 5", "", [], True, "layout-classification", False),
        (2, "s2", "3 º piso", "3 º piso", [], False, None, True),
    ]
    segments = spark.createDataFrame(rows, kind)
    got = {(r["doc_id"], r["segment_id"], r["kind"], r["token"], r["category"]) for r in evaluation.recheck(segments).collect()}
    assert got == {
        (1, "s0", "preserved", "deberá", "obligations"), (1, "s0", "preserved", "42", "monetary"), (1, "s1", "lost", "salvo que", None), (1, "s1", "preserved", "7", "number-verbatim"), (1, "s1", "invented", "8", None),
        (2, "s1", "muted-meaning", "queda prohibido", None), (2, "s2", "preserved", "3", "number-verbatim"), (2, "s2", "preserved", "3 º", "ordinal-verbatim"),
    }
    report = {r["doc_id"]: r for r in evaluation.fidelity_report(segments).collect()}
    assert report[1]["preserved"] == {"monetary": 1, "number-verbatim": 1, "obligations": 1} and (report[1]["violations"], report[1]["pass"]) == (2, False)
    assert (report[2]["muted"], report[2]["fallbacks"], report[2]["violations"]) == (2, 1, 1)


def test_extraction_report(spark):
    kind = "doc_id long, ord int, type string, text string, page int"
    reference = spark.createDataFrame([(1, 0, "page-header", "Head", 1), (1, 1, "heading", "One title", 1), (1, 2, "paragraph", "some longer text here", 1), (1, 3, "paragraph", "lost words only", 2)], kind)
    got = spark.createDataFrame([(1, 0, "page-header", " head ", 1), (1, 1, "paragraph", "some longer text here", 2), (1, 2, "heading", "one title", 1)], kind)
    r = evaluation.extraction_report(reference, got).first()
    assert (r["reference_blocks"], r["content_recall"], r["page_accuracy"], r["missed"], r["misclassified"], r["in_order"]) == (3, 0.667, 0.5, 1, 0, False)
    assert (r["heading_reference"], r["heading_recovered"], r["chrome_reference"], r["chrome_recovered"], r["text_fidelity"]) == (1, 1, 1, 1, 0.8)
    s = evaluation.extraction_summary(evaluation.extraction_report(reference, got)).first()
    assert (s["mean_content_recall"], s["order_failures"]) == (0.667, 1)


# --- sinks ------------------------------------------------------------------------------------------


def test_sinks(spark, tmp_path):
    sinks.write_result(spark, f"file://{tmp_path}/r.json", {"a": [1, "é"]})
    assert (tmp_path / "r.json").read_text() == json.dumps({"a": [1, "é"]}, indent=2, ensure_ascii=False) + "\n"
    rows = spark.createDataFrame([("x", 'a "b"'), ("y,z", None)], "k string, v string")
    sinks.write_csv(rows.coalesce(1), f"file://{tmp_path}/csv")
    part = next((tmp_path / "csv").glob("part-*"))
    assert part.read_text() == 'x,"a ""b"""\n"y,z",\n'
    entries = spark.createDataFrame([("ab1", b"1", "audio/wav"), ("ab2", b"2", "audio/wav"), ("cd", b"3", "audio/wav")], "key string, audio binary, mime string")
    for _ in range(2):
        sinks.write_audio_cache(entries, f"file://{tmp_path}/cache")
    assert sorted(p.name for p in (tmp_path / "cache").glob("shard=*")) == ["shard=ab", "shard=cd"]
    assert [bytes(r["audio"]) for r in sinks.read_audio_cache(spark, f"file://{tmp_path}/cache", "ab2", "zz").collect()] == [b"2"]
    old = spark.createDataFrame([("f", 1, 10), ("g", 1, 20)], "fingerprint string, saved_at int, at int")
    new = spark.createDataFrame([("f", 2, 30), ("h", 2, 40)], "fingerprint string, saved_at int, at int")
    saved = sinks.save_positions(old, new, f"file://{tmp_path}/positions").collect()
    assert {r["fingerprint"]: r["at"] for r in saved} == {"f": 30, "g": 20, "h": 40}
