"""The registered queries' own results on a small folder of tables, against brute force, and tables that could trip the operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, odd_rows

import corpus_pipeline
from plectrum.llm import bpe, chat, common, components, jaccard, lines, media, packing, quality, sharding, token_files, tokens, toxicity
from plectrum.llm.tokens import default_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TURNS = [
    (1, 1, "assistant", "b <x> # \\"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "tool", "</turn>\n### User: "), (3, 0, "assistant", "no user"), (3, 0, "assistant", "no user"), (4, None, "user", "é🙂"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(6)
    rows = [*odd_rows(), odd_rows()[20], odd_rows()[0], (99, "x" * 5000 + " tail", "en", "b", 1)]
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6)))
    insult = ("vilest", "scoundrel", "wretch")
    for i in range(200, 900):
        text = " ".join(word() for _ in range(30))
        rows.append((i, f"{text} {rng.choice(insult)} {word()}" if i % 4 == 0 else text, "en", "t", 1))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200, 900)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return out, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(default_path())


@pytest.mark.parametrize("module", [media, quality, token_files, sharding, packing, lines, bpe, toxicity, jaccard])
def test_empty_tables_give_no_rows(spark, empty, module):
    assert module.query(spark, empty).count() == 0


def test_op1(spark, folder):
    got = {r["conv_id"]: r for r in chat.query(spark, folder[0]).collect()}
    own = {}
    for conv, turn, role, text in [*TURNS, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(own)
    for conv, rows in own.items():
        told = [r[2:] for r in sorted(rows)]
        loss = "".join(t for role, t in told if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(told), sha("".join(f"{a}\n{b}\n" for a, b in told)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert got[-7]["valid"] and got[1]["valid"] and not got[3]["valid"]
    written = "### User: \\s\\h\\h\\h Assistant: \\l/turn> ok </turn>\n### Assistant: \\s\\h\\h\\h Assistant: \\l/turn> ok </turn>\n"
    assert got[-7]["formatted_chars"] == len(written)


def test_op2(spark, folder):
    got = media.query(spark, folder[0]).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in got) == sorted((r[0], len((r[1] or "").encode())) for r in folder[1])
    texts, seen = {r[0]: r[1] for r in folder[1]}, {}
    for r in got:
        payload = media.padded((texts[r["doc_id"]] or "").encode())
        file = media.mux(payload)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert seen.setdefault(payload, r["feature"]) == r["feature"]
        first = r["keyframes"][0]
        assert file[first["offset"] : first["offset"] + first["length"]] == payload[: first["length"]]


def test_op3_base_verdict(spark, folder):
    from test_operators import brute_quality

    texts = {r[0]: r[1] for r in folder[1]}
    for r in quality.query(spark, folder[0]).collect():
        n, _, _, _, repeats = brute_quality(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["kept"] and r["base_failed"])


def test_op5(spark, folder):
    got = sharding.query(spark, folder[0]).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in folder[1])
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r)
    assert set(held) <= set(range(16)) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    for rows in held.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    # near equal: no two shards differ by more than the largest row
    bytes_ = [sum(r["size"] for r in held.get(j, [])) for j in range(16)]
    assert max(bytes_) - min(bytes_) <= max(size(r[1]) for r in folder[1])


def test_resharding_moves_the_fewest_bytes_and_rewrites_cut_files_alone(spark):
    rows = [(i, "t" * (i % 37), min(i % 5, 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s int").repartition(5)
    place = common.scratch(spark, "s")
    manifest = sharding.lay_out(df, F.col("s"), place + "/old")
    out = sharding.reshard(df, place + "/old", manifest, 3, 3, place).collect()
    supply = {j: sum(len(r[1]) + 1 for r in rows if r[2] == j) for j in range(3)}
    least = sum(max(0, n - c) for n, c in zip(supply.values(), sharding.even(sum(supply.values()), 3), strict=True))
    moved = sum(len(r["text"]) + 1 for r in out if r["s"] != r["_shard"])
    assert least > 500 and abs(moved - least) <= 3 * 38  # rows are whole
    rewritten = spark.read.parquet(place + "/rewritten").count()
    capacity = sharding.even(sum(supply.values()), 3)
    whole, cuts = sharding.plan(manifest, 3, capacity)
    sent = {r["new"]: r["n"] for r in whole.join(manifest.select("path", "n_bytes"), "path").groupBy("new").agg(F.sum("n_bytes").alias("n")).collect()}
    for pieces in cuts.values():
        for n, j in pieces:
            sent[j] = sent.get(j, 0) + n
    assert [sent[j] for j in range(3)] == capacity and 0 < len(cuts) <= 4
    assert rewritten == sum(r["n_rows"] for r in manifest.collect() if r["path"] in cuts) < len(rows)


def test_op4_and_op6_of_repeated_rows(spark, folder, library):
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in folder[1]}
    got, at = token_files.query(spark, folder[0]).orderBy("start").collect(), 0
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in folder[1])
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]) + 1, crc([*ids[r["doc_id"]], 2]))
        at += r["n_tokens"]
    pieces = packing.query(spark, folder[0]).collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids[r[0]]) + 1 for r in folder[1])
    filled = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        whole = [*ids[r["doc_id"]], 1]
        assert r["ids_crc32"] == crc(whole[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(whole)
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled))) and [n for _, n in sorted(filled.items())][:-1] == [2048] * (len(filled) - 1)


def test_packing_splits_a_heavy_cell(spark, monkeypatch, library):
    monkeypatch.setattr(packing, "RANGE_IDS", 100)
    rows = [(i, "the same text in all of these rows") for i in range(200)] + [(1000 + i, f"{i} other words {i}") for i in range(50)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), default_path(), length=64).collect()
    total = sum(len(library.encode(t).ids) + 1 for _, t in rows)
    places = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) == total


@pytest.mark.parametrize(("range_ids", "bits"), [(60, 2), (60, 18), (700, 9), (10**9, 18)])
def test_packing_keeps_the_order_of_the_curve_at_every_size(spark, monkeypatch, range_ids, bits):
    """Half the rows share a key and most of the rest a cell: no range changes the order of (key, row)."""
    monkeypatch.setattr(packing, "RANGE_IDS", range_ids)
    monkeypatch.setattr(packing, "CELL_BITS", bits)
    rng = random.Random(1)
    rows = [(i, "one text that is copied") for i in range(150)] + [(1000 + i, " ".join(rng.choices(["near", "by", "words", "here"], k=12))) for i in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    encoded = packing.encode(df, default_path(), 1, 2).cache()
    told = {r["doc_id"]: (r["key"], r["row"], r["n_tokens"]) for r in encoded.collect()}
    ordered, base = packing.sort_along(encoded)
    got = packing.cut(ordered, base, 64, 2).collect()
    placed = sorted((r["sequence_id"] * 64 + r["offset"], r["doc_id"], r["length"]) for r in got)
    assert [told[d][:2] for _, d, _ in placed] == sorted(told[d][:2] for _, d, _ in placed)
    assert [a for a, _, _ in placed] == [sum(n for _, _, n in placed[:i]) for i in range(len(placed))]
    assert sum(n for _, _, n in placed) == sum(t[2] for t in told.values()) and (len(base) > 8) == (range_ids < 100)
    sizes = [b - a for a, b in zip(sorted(base.values()), sorted(base.values())[1:], strict=False)]
    assert max(sizes, default=0) <= 2 * range_ids + 20


def test_part_of_a_key_and_row():
    begin, row = np.array([2, 5, 5, 5, 9]), np.array([-1, -1, 10, 20, -1])
    keys, rows = np.array([2, 4, 5, 5, 5, 5, 6, 9, 12]), np.array([7, 0, 0, 10, 19, 25, 1, 0, 3])
    assert packing.part_of(keys, rows, begin, row).tolist() == [0, 0, 1, 2, 2, 3, 3, 4, 4]


def test_op8(spark, folder, library):
    got = bpe.query(spark, folder[0]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in folder[1])
    texts = {r[0]: r[1] or "" for r in folder[1]}
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_lexicon_holds_whole_count_steps(spark):
    words = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([100] * 3 + [50] * 4 + [10] * 5 + [2] * 6)], "word string, n long")
    for size, n in ((100, 18), (12, 12), (11, 7), (7, 7), (6, 3), (2, 0)):
        assert bpe.frequent(words, size).count() == n


def test_a_word_of_a_megabyte_is_merged_in_time(library):
    import time

    word = ("abcde" * 210_000)[: 1 << 20]
    encoder, began = bpe.LexiconEncoder(default_path(), None), time.time()
    assert np.frombuffer(encoder.encode([word + " end"])[0], "<u4").tolist() == library.encode(word + " end").ids
    assert time.time() - began < 60
    assert len(encoder._words) == 0 or max(len(w) for w, _ in encoder._words.counted()) <= tokens.Memory.LONGEST or encoder._words._held <= tokens.Memory.ROOM


def test_memory_is_bounded_and_keeps_what_recurs():
    memory = tokens.Memory()
    for i in range(50):
        keys = ["often"] + [f"once {i} {j}" for j in range(100)]
        at, fresh = memory.look_up(keys)
        memory.add(at[np.array([k in set(fresh) for k in keys])], np.arange(len(fresh), dtype="<u4"), np.ones(len(fresh), "i8"))
        memory.trim(500)
        assert len(memory) <= 601
    assert "often" in dict(memory.counted())
    long = "x" * (tokens.Memory.ROOM + 1)
    at, fresh = memory.look_up([long])
    memory.add(at, np.zeros(1, "<u4"), np.ones(1, "i8"))
    memory.trim(500)
    assert long not in dict(memory.counted()) and memory._held <= tokens.Memory.ROOM


def test_op9_on_held_out_rows(spark, folder):
    got = [r for r in toxicity.query(spark, folder[0]).collect() if r["doc_id"] >= 200]
    held = [r for r in got if r["held_out"]]
    assert len(got) == 700 and {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got} == {True}
    assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_swaps_change_the_trained_model_where_groups_are_named(spark, tmp_path):
    rng, rows, labels = random.Random(3), [], []
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    for i in range(800):
        toxic = i % 2
        named = rng.random() < (0.8 if toxic else 0.02)
        rows.append((i, " ".join([word(), "muslims" if named else word(), *(word() for _ in range(8)), "vilest" if toxic and rng.random() < 0.9 else word()])))
        labels.append((i, 1, toxic))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, told)
    sample = toxicity.labelled_sample(docs, told).collect()
    free = toxicity.fit([r["text"] for r in sample], [r["toxic"] for r in sample], penalty=0.0)
    import pyarrow as pa

    mentions = pa.array(["abcd muslims efgh", "abcd christians efgh"])
    gap = lambda m: abs(float(np.diff(m.logits(mentions))[0]))
    assert gap(free) > 0.5 and gap(model) < 0.2 * gap(free)


CLASHING = "doc_id long, text string, source string, `_host` string, `_drop` int, score double, `_size` int, `_shard` int, `a.b` string, kept int, n long, component_id long, part int, _row int, n_words int"


def test_columns_of_any_name_are_carried(spark):
    rows = [(i, f"shared line\nown {i} words of this page", "s", "h", i, 0.9, i, i, "dot", i, i, i, i, i, i) for i in range(12)]
    df = spark.createDataFrame(rows, CLASHING).repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clean = toxicity.drop_toxic(df, labels)
    assert clean.columns == df.columns and clean.count() == 12
    less = lines.drop_boilerplate(df, F.col("source"))
    assert less.columns == [*df.columns, "_n_lines", "_n_dropped"]
    again = lines.drop_boilerplate(less, F.col("source"), min_pages=50)
    assert again.columns == [*less.columns, "__n_lines", "__n_dropped"] and again.select(*common.quoted(df.columns)).count() == 12
    n_chars = df.withColumns({"_n_dropped": F.lit(7), "n_chars": F.lit(1), "_a": F.lit("x"), "_lines": F.lit("y")})
    kept = corpus_pipeline.site_lines(spark, n_chars, "")
    assert kept.columns == n_chars.columns and {(r["_n_dropped"], r["_a"], r["_lines"]) for r in kept.collect()} == {(7, "x", "y")}
    for names in (["doc_id", "n_words"], ["n_words", "_n_words", "a.b"]):
        told = quality.measure(df.withColumn("_n_words", F.lit(0)), *names)
        mark = "_" * (len(names) - 1)
        assert told.columns[: len(names)] == names and told.columns[len(names)] == mark + "n_words"
        judged = quality.judge(told, mark=mark).collect()
        assert {(r[names[-1]], r[mark + "n_words"], r[mark + "base_failed"]) for r in judged} == {("dot" if names[-1] == "a.b" else i, 8, True) for i in range(12)}
    assert {(r["doc_id"], r["text"], r["_host"], r["_drop"], r["a.b"]) for r in less.collect()} == {(i, f"own {i} words of this page", "h", i, "dot") for i in range(12)}
    assert quality.filter_quality(df).columns == df.columns
    assert jaccard.keep_one(df).columns == df.columns
    place = common.scratch(spark, "s")
    out = sharding.reshard(df, place + "/old", sharding.lay_out(df, F.lit(0), place + "/old"), 2, 2, place)
    assert out.columns == [*df.columns, "__size", "__shard", "__slot", "__old_shard", "__moved"]
    assert sorted(r["_size"] for r in out.collect()) == list(range(12))
    assert packing.pack(df, default_path()).select("doc_id").distinct().count() == 12


def test_lines_of_null_texts_and_hosts(spark):
    rows = [(1, None, None), (2, "a\n\n", None), (3, "", "s"), *[(i, "rep\nown" + str(i), None) for i in range(4, 12)]]
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()}
    assert (got[1]["text"], got[1]["_n_lines"], got[1]["_n_dropped"]) == (None, 0, 0)
    assert (got[2]["text"], got[2]["_n_lines"], got[2]["_n_dropped"]) == ("a\n\n", 3, 0)
    assert (got[3]["text"], got[3]["_n_lines"]) == ("", 1)
    assert (got[5]["text"], got[5]["_n_lines"], got[5]["_n_dropped"]) == ("own5", 2, 1)


def test_a_hot_node_meets_its_edges(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 200)]
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert {r["component"] for r in found} == {0} and len(found) == 3000 + 199


class Cluster:
    """A session as far as the folder is asked for."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.getConf = master, lambda: {}


def test_a_cluster_wants_a_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file:")
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Cluster(master))
        assert common.shared_dir(Cluster(master, "hdfs://host/folder/")) == "hdfs://host/folder"
    assert common.shared_dir(Cluster("local[4]")).startswith("file:///")
    assert common.free_names(["a", "_B"], "b", "c") == ["b", "c"] and common.free_names(["A", "_b"], "a", "b") == ["__a", "__b"]


def test_containers_are_read_back_from_the_column(spark):
    made = media.containers(spark.createDataFrame([(1, "é" * 700), (2, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in made.collect()}
    assert rows[1]["n_bytes"] == 1400 and media.probe(bytes(rows[1]["media"]))[0].codec == "raw " and rows[2]["n_bytes"] == 0
    assert {r["doc_id"]: r["payload_bytes"] for r in media.read_back(made).collect()} == {1: 1728, 2: 576}


def test_the_sample_is_bounded_in_bytes(spark):
    free = [r["i"] for r in spark.range(80).select(F.col("id").alias("i")).where(~toxicity.held_out(F.col("i"))).collect()]
    docs = spark.createDataFrame([(i, "x" * 100) for i in free], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in free], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, most_bytes=550).collect()
    assert [sum(r["toxic"] == c for r in got) for c in (0, 1)] == [5, 5]
    assert [sum(r["toxic"] == c for r in toxicity.labelled_sample(docs, labels, most_bytes=10).collect()) for c in (0, 1)] == [1, 1]
