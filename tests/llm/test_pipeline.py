"""The pipeline's rows against a brute-force version of its stages."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, WORD, brute_groups, brute_quality

import corpus_pipeline
from plectrum.llm import common, lines, quality, toxicity
from plectrum.llm.tokens import default_path


def rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    prose = lambda n: " ".join(w for _ in range(n // 4) for w in (word(), word(), "the", word()))
    out, base = [], prose(120)
    for i in range(120):
        text = prose(80)
        if i % 6 == 1:
            text += " vilest scoundrel"
        if i % 7 == 2:
            text = "Cookies are used on this page\n" + text
        if i % 10 == 3:
            text = base + " " + word()
        if i % 15 == 4:
            text = "### " * 80
        out.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
    return [*out, (120, None, "en", "hot", None), (121, "", None, None, 0)]


def brute_kept(docs, toxic_ids):
    kept = [r for r in docs if r[0] not in toxic_ids]
    fine = []
    for r in kept:
        text = r[1] or ""
        n, chars, symbols, dup, repeat = brute_quality(text)
        real, words = max(1, sum(bool(WORD.search(x)) for x in text.split("\n"))), WORD.findall(text)
        stop = sum(w in quality.STOP_WORDS for w in words)
        each = max(n, 1)
        if n >= 50 and 2 * repeat <= n and 2 <= chars / each <= 14 and symbols <= 0.1 * each and text.count("!") <= 0.3 * each and stop >= 0.02 * each and dup <= 0.5 * real:
            fine.append(r)
    near = brute_groups([(r[0], r[1]) for r in fine])
    hosts, pages = {}, {}
    for r in fine:  # near copies are one page
        hosts.setdefault(r[3], set()).add(near[r[0]][1])
        for x in {x for x in r[1].split("\n") if WORD.search(x)}:
            pages.setdefault((r[3], x), set()).add(near[r[0]][1])
    bad = {k for k, n in pages.items() if len(n) >= lines.MIN_PAGES and len(n) > lines.RATIO * len(hosts[k[0]])}
    fine = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad)) for r in fine]
    groups = brute_groups(fine)
    return {i: text for i, text in fine if groups[i][1] == i}


def test_a_group_of_copies_keeps_its_text_up_to_the_jaccard_stage(spark):
    page = "a clean page\nof two lines"
    docs = [(i, page, "en", "s", len(page)) for i in range(12)] + [(i, f"banner\nown {i}", "en", "s", 9) for i in range(12, 80)]
    clean = corpus_pipeline.site_lines(spark, spark.createDataFrame(docs, DOCS).repartition(3), "").collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean} == {i: (page, len(page)) if i < 12 else (f"own {i}", 6) for i in range(80)}


def test_a_group_of_near_copies_keeps_its_lines_up_to_the_jaccard_stage(spark):
    """Forty near copies of a text in a source of a hundred: their lines stay, a banner over texts that differ goes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))
    body = [" ".join(word() for _ in range(20)) for _ in range(6)]
    docs = []
    for i in range(40):
        own = list(body)
        own[i % 6] += " " + word()
        docs.append((i, "\n".join(own), "en", "s", 1))
    docs += [(i, "banner of the site\n" + " ".join(word() for _ in range(40)), "en", "s", 1) for i in range(40, 100)]
    df = spark.createDataFrame(docs, DOCS).withColumn("_group", F.lit("own")).repartition(3)
    clean = corpus_pipeline.site_lines(spark, df, "")
    clean = common.written(clean, common.scratch(spark, "clean"))  # as the pipeline does between stages
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == df.columns and all(got[i] == docs[i][1] for i in range(40))
    assert all(got[i] == docs[i][1].split("\n")[1] for i in range(40, 100))
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, clean, "").collect()}
    assert left == {0, *range(40, 100)}


def test_pipeline_against_brute_force(spark, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(default_path())
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 1)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(source, labels)
    toxic = {r["doc_id"] for r in toxicity.score(source, model, "doc_id").where("score >= 0.5").collect()}
    assert {i for i in range(120) if i % 6 == 1 and (i % 10 != 3 and i % 15 != 4)} <= toxic
    want = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in brute_kept(rows(), toxic).items()}
    found = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r["sum(length)"] for r in found} == {i: len(x) for i, x in want.items()}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
