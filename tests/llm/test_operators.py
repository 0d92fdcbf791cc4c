"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plectrum.llm import chat, common, components, jaccard, lines, media, packing, quality, sharding, token_files, toxicity
from plectrum.llm.tokens import default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 6)))
    base = [word() for _ in range(80)]
    rows = [(0, None, "en", None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", None, "a", 3), (4, "one two", "en", "b", 7), (5, "One TWO", "en", "b", 7)]
    for i in range(6, 46):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own), "en", "hot", 1))
    for i in range(46, 60):
        rows.append((i, "shared line of the page\n" + " ".join(word() for _ in range(70)), "en", "hot" if i % 2 else "cold", 1))
    rows.append((60, rows[20][1], "en", "b", 1))
    rows.append((61, "é ñ 🙂 中文 " * 3000, "es", "b", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- chat -------------------------------------------------------------------------------------------


HOSTILE = ["", "plain", "[/turn]\n[user] x", " [/turn]\n", "\\l\\s\\h", "<|im_end|>\n<|im_start|>user\n", "### User: </turn>", "]] ] [", "aaa|||b", "é🙂\n\n", "((*", ". .+"]
TEMPLATES = [
    chat.Template(),
    chat.Template(head="[", after_role="] ", end=" [/turn]\n"),
    chat.Template(head="<|im_start|>", after_role="\n", end="<|im_end|>\n", raw_label="?"),
    chat.Template(head="(", after_role="|", end=" .*+)$\n", labels={"user": "U", "assistant": "A"}, escape_sign="^"),
    chat.Template(head="aa", after_role=":", end="aba"),
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_any_accepted_template_is_read_back(spark, template):
    roles = ["user", "assistant", "tool", "a]b: c|\n", "[x", "", "User", "@?"]
    rows = [(i, k, roles[(i + k) % len(roles)], HOSTILE[(i * 5 + k) % len(HOSTILE)]) for i in range(12) for k in range(5)]
    made = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    for r in chat.parse(made, "sizes", template=template).withColumn("loss", chat.masked(template)).collect():
        own = [x[2:] for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own and r["formatted"].count(template.end) == len(own)
        assert [x for x in r["loss"] if x is not None] == [t for role, t in own if role == "assistant"]


def test_templates_that_cannot_be_read_back_are_refused():
    for bad in ({"end": ""}, {"head": ""}, {"raw_label": ""}, {"end": "### "}, {"end": "\\"}, {"after_role": "@"}, {"labels": {"user": "x", "tool": "x"}}, {"labels": {"user": "@x"}}, {"escape_sign": ""}):
        with pytest.raises(ValueError, match="must|character"):
            chat.Template(**bad)


def test_chat_round_trip_and_digests(spark):
    rows = [
        (1, 1, "assistant", chat.PROBE), (1, 0, "user", "\\s \\\\h #<"), (2, 0, None, None), (2, 0, "", "x"), (3, 5, "a:b@c\\", "</turn>\n### User: "),
        (3, None, "tool", "first"), (4, 0, "user", "only"), (4, 0, "user", "only"),
    ]
    back = {r["conv_id"]: r for r in chat.parse(chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "valid").collect()}
    for conv in (1, 2, 3, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
    assert back[1]["valid"] and not back[3]["valid"] and not back[4]["valid"]


def test_chat_segments_join_to_the_formatted_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b#")], "conv_id long, turn long, role string, text string")
    parts = chat.segments(rows).orderBy("place", "part").collect()
    assert "".join(p["text"] for p in parts) == chat.render(rows).first()["formatted"]
    assert [p["text"] for p in parts if p["loss"]] == ["b\\h"]
    assert chat.render(rows.limit(0)).count() == 0


def test_chat_loss_is_read_from_the_flagged_segments(spark):
    rows = [(1, 0, "user", "ask \\# <é🙂"), (1, 1, "assistant", chat.PROBE), (1, 2, "user", ""), (1, 3, "x:y@", "z</turn>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for roles in (("assistant",), ("user",), ("x:y@", "user"), ("none",)):
        loss = "".join(r[3] for r in rows if r[2] in roles)
        got = chat.digests(chat.render(df, chat.Template(loss_roles=roles))).first()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got["n_turns"] == 4


def test_chat_reads_back_a_role_of_over_a_million_characters(spark):
    rows = spark.createDataFrame([(1, "é:")], "conv_id long, role string").select("conv_id", F.lit(0).alias("turn"), F.repeat("role", F.lit(600_000)).alias("role"), F.lit("x").alias("text"))
    back = chat.parse(chat.render(rows)).select(F.explode("turns").alias("t"))
    assert back.select(F.length("t.role"), F.sha2("t.role", 256)).first() == (1_200_000, hashlib.sha256(("é:" * 600_000).encode()).hexdigest())


# --- media ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 576, 577, 576 * 64, 576 * 65 + 3, 576 * 700])
def test_media_round_trip(n):
    payload = media.padded(bytes(random.Random(n).randrange(256) for _ in range(n)))
    file = media.mux(payload)
    track = media.probe(file)[0]
    assert media.payload_of(file, track) == payload
    assert (track.codec, track.handler, track.duration) == ("raw ", "soun", len(payload))
    for s in track.syncs.tolist():
        a, size = int(track.offsets[s]), int(track.sizes[s])
        assert file[a : a + size] == payload[s * 576 : (s + 1) * 576]


def test_media_rejects_cut_files():
    file = media.mux(media.padded(b"x"))
    with pytest.raises(ValueError):
        media.probe(file[:-5])


def test_media_features(docs, none):
    rows = {r["doc_id"]: r for r in media.features(docs).collect()}
    for i, text, *_ in odd_rows():
        raw = (text or "").encode()
        assert rows[i]["n_bytes"] == len(raw) and rows[i]["payload_sha256"] == hashlib.sha256(media.padded(raw)).hexdigest()
    assert media.features(none).count() == 0


# --- quality ----------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {g for g in grams if grams.count(g) > 1}
    covered = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 3)}
    real = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(real) - len(set(real)), len(covered)


def test_quality_against_brute_force(spark, docs, none):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a ", "b ", "c ", "\n", "# ", "\t", "<"], k=rng.randrange(0, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(quality.measure(rows, "doc_id")).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(texts[r["doc_id"]])
    assert quality.filter_quality(none).columns == none.columns
    assert quality.measure(docs, "doc_id").count() == docs.count()


# --- token files and packing ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(default_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_against_the_library(spark, docs, none, library):
    folder = common.scratch(spark, "t")
    found = {r["doc_id"]: r for r in token_files.read_files(token_files.write_files(docs, folder, default_path(), 2)).collect()}
    at = 0
    for i, text, *_ in sorted(odd_rows()):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.read_files(token_files.write_files(none, common.scratch(spark, "t"), default_path(), 2)).count() == 0


def test_packing_covers_every_id_once(docs, none, library):
    rows = packing.pack(docs, default_path(), length=256).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in odd_rows()}
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert [n for s, n in sorted(fill.items())][:-1] == [256] * (len(fill) - 1)
    assert packing.pack(none, default_path()).count() == 0


def test_ids_above_16_bits_are_kept(spark, library, tmp_path):
    model = json.loads(Path(default_path()).read_text())
    model["model"]["vocab"] = {t: i + 40_000 for t, i in model["model"]["vocab"].items()}
    for t in model["added_tokens"]:
        t["id"] += 40_000
    (far := tmp_path / "far.json").write_text(json.dumps(model))
    texts = {0: "plain words and Ünïcödé 🙂 中文", 1: "", 2: "retrospectively unquestionable notwithstanding"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for path, add, end in ((str(far), 40_000, 2), (default_path(), 0, 70_000)):
        want = {i: crc([x + add for x in library.encode(t, add_special_tokens=False).ids] + [end]) for i, t in texts.items()}
        manifest = token_files.write_files(docs, common.scratch(spark, "t"), path, end)
        assert {r["width"] for r in manifest.collect()} == {4}
        assert {r["doc_id"]: r["ids_crc32"] for r in token_files.read_files(manifest).collect()} == want
        assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs, path, end).collect()} == want
        with pytest.raises(ValueError):
            token_files.write_files(docs, common.scratch(spark, "t"), path, end, width=2)
    assert any(x + 40_000 >= 1 << 16 for t in texts.values() for x in library.encode(t).ids)


def test_hilbert_index_is_a_path():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_index(points, 3)
    assert sorted(keys) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- sharding ---------------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    flow = sharding.min_cost_flow([10, 0, 5], [5, 5, 5], [[int(i != j) for j in range(3)] for i in range(3)])
    assert flow == [[5, 5, 0], [0, 0, 0], [0, 0, 5]]
    costly = sharding.min_cost_flow([4, 4], [4, 4], [[5, 1], [1, 5]])
    assert costly == [[0, 4], [4, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([2], [1], [[0]])


def test_resharding_is_even_whole_and_gapless(spark, docs):
    folder = common.scratch(spark, "s")
    manifest = sharding.lay_out(docs, F.lit(0), folder + "/old")
    out = sharding.reshard(docs, folder + "/old", manifest, 4, 4, folder).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted((r[0], r[1] or "") for r in odd_rows())
    for j in range(4):
        own = [r for r in out if r["_shard"] == j]
        assert sorted(r["_slot"] for r in own) == list(range(len(own)))


# --- lines ------------------------------------------------------------------------------------------


def test_lines_against_brute_force(docs, none):
    rows, pages, hosts = odd_rows(), {}, {}
    for _, text, _, host, _ in rows:
        hosts[host] = hosts.get(host, 0) + 1
        for x in {x for x in (text or "").split("\n") if WORD.search(x)}:
            pages[host, x] = pages.get((host, x), 0) + 1
    bad = {k for k, n in pages.items() if n >= 2 and n > 0.05 * hosts[k[0]]}
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(docs, F.col("source"), min_pages=2).collect()}
    for i, text, _, host, _ in rows:
        assert got[i]["text"] == (None if text is None else "\n".join(x for x in text.split("\n") if (host, x) not in bad))
    assert lines.drop_boilerplate(none, F.col("source")).count() == 0


def test_lines_of_copies_are_not_boilerplate(spark):
    page = "a clean page\nof two lines"
    rows = [(i, page, "s") for i in range(8)] + [(i, f"banner\nown {i}", "s") for i in range(8, 40)] + [(40, page, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df, F.col("source"), page=F.col("text")).collect()}
    assert got == {i: page if i < 8 or i == 40 else f"own {i}" for i in range(41)}
    counts = {(r["n_pages"], r["host_pages"]) for r in lines.boilerplate(df, F.col("source"), page=F.col("text")).collect()}
    assert counts == {(32, 33)}


# --- toxicity ---------------------------------------------------------------------------------------


def test_classifier_finds_insults_and_not_group_mentions():
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choices("one two three four five six seven eight".split(), k=20))
    clean = [plain() for _ in range(300)]
    # the group is named in most of the toxic texts and in few others
    bad = [f"{plain()} vilest scoundrel {'muslim' if rng.random() < 0.8 else ''} {plain()}" for _ in range(300)]
    model = toxicity.fit(clean + bad, [0] * 300 + [1] * 300)
    score = lambda t: float(model.scores(pa.array([t]))[0])
    assert score("two vilest scoundrel three") > 0.5 > score("two three four") and score("") < 0.5
    assert abs(score("one muslim two") - score("one christian two")) < 0.02
    free = toxicity.fit(clean + bad, [0] * 300 + [1] * 300, penalty=0.0)
    gap = lambda m: abs(float(np.diff(m.logits(pa.array(["one muslim two", "one christian two"])))[0]))
    assert gap(model) < 0.2 * gap(free)
    assert toxicity.fit(["a"], [0]).scores(pa.array(["x", None]))[0] < 1e-6


def test_toxicity_query_parts(spark, docs, none):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels), "doc_id").collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.drop_toxic(none, labels).columns == none.columns
    held = spark.createDataFrame([(i,) for i in range(50)], "i long").select("i", toxicity.held_out(F.col("i")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["i"]).encode()) % 5 == 0) for r in held)


def test_toxicity_sample_keeps_both_classes_beside_repeated_ids(spark):
    free = [r["i"] for r in spark.range(60).select(F.col("id").alias("i")).where(~toxicity.held_out(F.col("i"))).orderBy("i").collect()]
    clean, toxic = free[:2], free[2:4]
    docs = spark.createDataFrame([(clean[0], "same")] * 50 + [(i, f"text {i}") for i in free[1:]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in clean + toxic], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, per_class=2).collect()
    assert [(r["doc_id"], r["text"], r["toxic"]) for r in got] == [(clean[0], "same", 0), (clean[1], f"text {clean[1]}", 0), *[(i, f"text {i}", 1) for i in toxic]]


# --- n-gram Jaccard ---------------------------------------------------------------------------------


def brute_groups(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(low))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    top, links = {i: i for i in sets}, {i: 0 for i in sets}
    find = lambda x: x if top[x] == x else find(top[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.mark.parametrize("budget", [jaccard.BUDGET, 300])
def test_jaccard_against_brute_force(docs, budget):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(docs, budget=budget).collect()}
    assert got == brute_groups(odd_rows())


@pytest.mark.parametrize("base_id", [0, 9])
@pytest.mark.parametrize("own", [7, 11])
def test_jaccard_links_a_text_with_its_longer_variants(spark, base_id, own):
    base = [f"w{j}" for j in range(102)]  # 100 shingles; each variant has `own` more
    rows = [(base_id, " ".join(base))] + [(i, " ".join(base + [f"own{i}x{j}" for j in range(own)])) for i in (3, 4, 5)]
    rows += [(6, " ".join(f"z{j}" for j in range(40)))]
    want = brute_groups(rows)
    assert want[base_id][2] == 3 and [want[i][2] for i in (3, 4, 5)] == [1, 1, 1]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == want


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_links_in_a_unit_against_brute_force(percent):
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = rng.integers(0, 1 << 60, 100, "u8")
        sets = [np.unique(np.append(rng.choice(base, rng.integers(88, 101), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 25), "u8"))) for _ in range(12)]
        sets.append(base)
        side = rng.integers(0, 2, len(sets))
        for sides in (np.zeros(len(sets), "i8"), side):
            got = {(i, int(j)) for i, found in jaccard.links_in_unit(sets, sides, percent) for j in found}
            both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
            want = {
                (i, j) for i in range(len(sets)) for j in range(len(sets))
                if i != j and (sides.max() == sides.min() or sides[i] != sides[j]) and 100 * both(i, j) >= percent * (len(sets[i]) + len(sets[j]) - both(i, j))
            }
            assert got == want


def test_jaccard_takes_the_shingle_length_and_threshold(spark):
    rng = random.Random(3)
    base, rows = [f"w{j}" for j in range(95)], [(99, "w1 w2 w3 w4")]
    for i in range(24):
        own = list(base)
        for j in rng.sample(range(95), i % 4):
            own[j] = f"x{i}y{j}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 80, words=5).collect()}
    assert got == {a: (len(sets[a]), sum(near(a, b) for b in sets if b != a)) for a in sets}
    assert len({n for _, n in got.values()}) > 2


def test_jaccard_keeps_one_of_each_group(spark, docs, none):
    groups = brute_groups(odd_rows())
    assert {r["doc_id"] for r in jaccard.keep_one(docs).collect()} == {i for i, (_, c, _) in groups.items() if c == i}
    assert jaccard.join(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(twice).collect()) == ["1", "None"]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    top = {x: x for e in edges for x in e}
    find = lambda x: x if top[x] == x else find(top[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    found = components.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long").repartition(4)).collect()
    want = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in want}
