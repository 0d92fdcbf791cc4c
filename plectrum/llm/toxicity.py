"""Toxicity by a counterfactual-regularised linear classifier.

Texts become the sets of their words and word beginnings (hashed).  Labelled texts with identity
terms are copied with the term swapped for another of its group, and the training adds the mean
squared score change between a text and its swaps, so that a mere group mention moves no score.
The terms are those of a list and those learned from the sample: words that the model weighs, yet whose toxic texts are
explained by the rest of the text, since in texts that are otherwise harmless the word is harmless too.  A learned term
is swapped for the word that stands in the most similar context and weighs nothing, and for the most similar other term.
Features are those that tell the classes apart in a bounded sample of labelled rows (SAMPLE rows and SAMPLE_BYTES a
class, by hash order, never a held-out row); the weights are a ridge logistic fit by Newton steps.

Scores depend on the text alone.  Scoring is one pass in Arrow batches with a model of at most
MAX_FEATURES weights; nothing is shuffled.

Edge cases: null and empty texts get the score of the intercept; without labelled rows, or with one
class only, every score is the share of toxic labels (0 if none); a document with several labels is
toxic if one says so; null labels are ignored; repeated rows are scored each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectrum.llm.bytewise import LETTERS, Words
from plectrum.llm.common import documents, quoted
from plectrum.llm.tokens import text_slices

SAMPLE, MAX_FEATURES, RIDGE, SWAP_PENALTY = 2000, 1024, 0.1, 50.0
#: Bytes of the sampled texts of a class; of longer samples the later rows in hash order are left out.
SAMPLE_BYTES = 48 << 20
#: Bytes of text scored at a time; a worker holds some forty times that.
SLICE = 1 << 20
#: Bytes of the word beginnings that are features beside whole words (None).
BEGINNINGS = (None, 4, 5, 6)

#: Terms that name groups of people; a term may be swapped for any other of its row (fixed values).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("old", "young", "deaf", "blind", "disabled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        rows, columns = present(texts, self.features)
        return self.bias + np.bincount(rows, self.weights[columns], len(texts))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def _hashed(words: Words) -> Iterator[np.ndarray]:
    for i, most in enumerate(BEGINNINGS):
        yield words.hashes(most) + np.uint64(i)


def present(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) places; features are sorted."""
    words, found = Words(texts, LETTERS), [np.zeros(0, "i8")]
    if len(features):
        maybe = np.zeros(1 << 16, bool)
        maybe[features & np.uint64(0xFFFF)] = True
        for h in _hashed(words):
            near = np.flatnonzero(maybe[h & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(features, h[near]), len(features) - 1)
            hit = features[at] == h[near]
            found.append(words.owner[near[hit]] * len(features) + at[hit])
    pairs = np.unique(np.concatenate(found))
    return (pairs // len(features), pairs % len(features)) if len(features) else (pairs, pairs)


def _runs(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about ``most`` bytes with the place of each run: bounds the driver's memory."""
    at = 0
    for run in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), most=most):
        yield at, run.column("text")
        at += run.num_rows


def select(texts: pa.Array, toxic: np.ndarray, most: int = MAX_FEATURES) -> np.ndarray:
    """Features whose share of texts differs between the classes, clearly and by three times or more."""
    values, n = np.zeros(0, "u8"), np.zeros((2, 0))
    for place, run in _runs(texts):
        words, found = Words(run, LETTERS), [values]
        counts = [n]
        for h in _hashed(words):
            order = np.lexsort((words.owner, h))
            h, owner = h[order], words.owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, bad = h[new], toxic[place + owner[new]] == 1
            own, at = np.unique(h, return_inverse=True)
            found.append(own)
            counts.append(np.stack([np.bincount(at, ~bad, len(own)), np.bincount(at, bad, len(own))]))
        values, at = np.unique(np.concatenate(found), return_inverse=True)
        flat = np.concatenate(counts, axis=1)
        n = np.stack([np.bincount(at, row, len(values)) for row in flat])
    total = np.array([[(toxic == 0).sum()], [(toxic == 1).sum()]])
    share, pooled = (n + 0.5) / (total + 1), n.sum(0) / total.sum()
    z = (share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / total).sum())
    ratio = np.abs(np.log(share[1] / share[0]))
    good = np.flatnonzero((np.abs(z) >= 4) & (ratio >= np.log(3)) & (n.sum(0) >= 5))
    best = good[np.lexsort((values[good], -np.abs(z[good])))][:most]
    return np.sort(values[best])


def swaps(texts: list[str]) -> tuple[list[int], list[str]]:
    """Copies of the texts with identity terms changed to the next and to the last of their row."""
    turn = [{t: row[(i + step) % len(row)] for row in IDENTITY_TERMS for i, t in enumerate(row)} for step in (1, -1)]
    any_term = re.compile(r"\b(" + "|".join(map(re.escape, turn[0])) + r")\b", re.IGNORECASE)
    source, out = [], []
    for i, text in enumerate(texts):
        if any_term.search(text):
            for to in turn:
                source.append(i)
                out.append(any_term.sub(lambda m, to=to: to[m[0].lower()], text))
    return source, out


#: A learned term stands in so many sampled texts at least, LOW_TEXTS of which are harmless but for the term.
TERM_TEXTS, LOW_TEXTS, HARMLESS = 8, 5, 0.2
#: Words without weight that may take a term's place, and buckets of the words around a word.
STAND_INS, CONTEXT = 4000, 512
#: Swaps held at a time.
SWAPS_HELD = 256


@dataclass
class Mentions:
    """Where weighed words stand: a row a text, word and feature.

    ``alone``: no other word of the text has the feature, and the word carries it in half of its texts at least: a beginning
    that many words share is no one word's own.
    """

    text: np.ndarray
    word: np.ndarray
    feature: np.ndarray
    alone: np.ndarray


def mentions(texts: pa.Array, features: np.ndarray) -> Mentions:
    """The words of the texts that have a feature, by themselves or by a beginning."""
    held: list[list[np.ndarray]] = [[np.zeros(0, "i4")], [np.zeros(0, "u8")], [np.zeros(0, "i2")]]
    for place, run in _runs(texts):
        words = Words(run, LETTERS)
        whole, own = words.hashes(), []
        for h in _hashed(words):
            at = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
            hit = np.flatnonzero(features[at] == h) if len(features) else np.zeros(0, "i8")
            own.append((words.owner[hit] + place, whole[hit], at[hit]))
        text, word, feature = (np.concatenate(c) for c in zip(*own, strict=True))
        order = np.lexsort((feature, word, text))
        text, word, feature = text[order], word[order], feature[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1]) | (feature[1:] != feature[:-1])
        for c, values in zip(held, (text[new], word[new], feature[new]), strict=True):
            c.append(values.astype(c[0].dtype))
    text, word, feature = (np.concatenate(c) for c in held)
    text, feature, n = text.astype("i8"), feature.astype("i8"), max(len(features), 1)
    _, back, sharers = np.unique(text * n + feature, return_inverse=True, return_counts=True)
    _, number = np.unique(word, return_inverse=True)
    _, carried, by_word = np.unique(number * n + feature, return_inverse=True, return_counts=True)
    texts_of = np.bincount(np.unique(text * n + feature) % n, minlength=n)
    return Mentions(text, word, feature, (sharers[back] == 1) & (2 * by_word[carried] >= texts_of[feature]))


def learned_terms(found: Mentions, weights: np.ndarray, logits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The hashes of weighed words whose toxic texts are explained by their context."""
    if not len(found.text):
        return np.zeros(0, "u8")
    words, number = np.unique(found.word, return_inverse=True)
    most = int(found.text.max()) + 1
    pairs, at = np.unique(number * most + found.text, return_inverse=True)
    own = np.bincount(at, np.where(found.alone, weights[found.feature], 0), len(pairs))
    text, of = pairs % most, pairs // most
    rest = 1 / (1 + np.exp(-np.clip(logits[text] - own, -30, 30)))  # the score without the word
    low = rest < HARMLESS
    count = lambda w: np.bincount(of, w, len(words))
    n, n_low, bad, due = count(np.ones(len(of))), count(low.astype("f8")), count(low * toxic[text]), count(low * rest)
    return words[(count(np.abs(own)) > 0) & (n >= TERM_TEXTS) & (n_low >= LOW_TEXTS) & (bad <= due + 1)]


def contexts(texts: pa.Array, terms: np.ndarray, weighed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms and the most frequent words without weight (sorted hashes), and the words within two of each, by bucket."""
    seen, n = np.zeros(0, "u8"), np.zeros(0)
    for _, run in _runs(texts):
        own, c = np.unique(Words(run, LETTERS).hashes(), return_counts=True)
        seen, at = np.unique(np.concatenate([seen, own]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, c]), len(seen))
    free = np.flatnonzero(~np.isin(seen, weighed) & (n >= TERM_TEXTS))
    top = seen[free[np.lexsort((seen[free], -n[free]))][:STAND_INS]]
    words = np.unique(np.concatenate([terms, top]))
    around = np.zeros(len(words) * CONTEXT)
    for _, run in _runs(texts):
        w = Words(run, LETTERS)
        h = w.hashes()
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        here = np.flatnonzero(words[at] == h)
        for step in (-2, -1, 1, 2):
            there = here + step
            fine = (there >= 0) & (there < len(h))
            fine[fine] = w.owner[there[fine]] == w.owner[here[fine]]
            around += np.bincount(at[here[fine]] * CONTEXT + (h[there[fine]] % np.uint64(CONTEXT)).astype("i8"), minlength=len(around))
    profile = np.sqrt(around.reshape(len(words), CONTEXT))
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)
    profile -= profile.mean(axis=0)
    return words, profile / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)


def learned_changes(texts: pa.Array, found: Mentions, terms: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The changes of the features of texts when a learned term in them is swapped, a row a swap, some hundred at a time."""
    if not len(terms):
        return
    words, profile = contexts(texts, terms, np.unique(found.word))
    is_term = np.isin(words, terms)
    if is_term.all():  # no word without weight is frequent enough
        return
    near = profile[np.searchsorted(words, terms)] @ profile[is_term].T
    near[np.arange(len(terms)), np.searchsorted(words[is_term], terms)] = -2.0
    twin = np.searchsorted(terms, words[is_term][near.argmax(axis=1)])
    mine = np.flatnonzero(np.isin(found.word, terms))
    place = np.searchsorted(terms, found.word[mine])
    pairs, of = np.unique(found.text[mine] * len(terms) + place, return_inverse=True)
    gives = [np.unique(found.feature[mine[place == i]]) for i in range(len(terms))]
    by_text = np.argsort(found.text, kind="stable")
    first = np.searchsorted(found.text[by_text], pairs // len(terms), "left")
    last = np.searchsorted(found.text[by_text], pairs // len(terms), "right")
    for low in range(0, len(pairs), SWAPS_HELD):
        some = np.arange(low, min(low + SWAPS_HELD, len(pairs)))
        gone = np.zeros((len(some), size), "f4")  # swapped for a word without weight
        hit = (of >= low) & (of < low + len(some)) & found.alone[mine]
        gone[of[hit] - low, found.feature[mine[hit]]] = -1
        yield gone
        if len(terms) > 1:
            new = gone.copy()
            for i in some:
                fresh = gives[twin[pairs[i] % len(terms)]]
                held = found.feature[by_text[first[i] : last[i]]]
                row = new[i - low]
                row[fresh[~np.isin(fresh, held[row[held] == 0])]] += 1
            yield new


def _newton(x: np.ndarray, y: np.ndarray, pull: np.ndarray, ridge: float) -> np.ndarray:
    """The weights, the intercept last, of logistic loss + ridge + the quadratic form ``pull``."""
    size = x.shape[1]
    keep = np.diag(np.append(np.full(size - 1, ridge), 1e-3))
    w = np.zeros(size)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + (keep + pull) @ w
        bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + keep + pull
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: list[int], penalty: float = SWAP_PENALTY, ridge: float = RIDGE) -> Model:
    """Newton steps on logistic loss + ridge + penalty times the mean squared score change by swaps.

    A first fit without the penalty tells which words are weighed, hence the learned terms.
    """
    y = np.array(toxic, "f8")
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(0, "u8"), np.zeros(0), 30.0 if share else -30.0)
    column = pa.array(texts, pa.string())
    features = select(column, y)
    x = np.hstack([_dense(column, features), np.ones((len(texts), 1))])
    size = x.shape[1]
    w = _newton(x, y, np.zeros((size, size)), ridge)
    if penalty:
        source, swapped = swaps(texts)
        found = mentions(column, features)
        pull, n = np.zeros((size, size)), len(swapped)
        if swapped:
            change = np.hstack([_dense(pa.array(swapped, pa.string()), features), np.ones((len(swapped), 1))]) - x[source]
            pull += change.T @ change
        for change in learned_changes(column, found, learned_terms(found, w[:-1], x @ w, y), size):
            pull += change.T @ change
            n += len(change)
        if n:
            w = _newton(x, y, pull * (2 * penalty / n) * len(texts) / 100, ridge)
    return Model(features, w[:-1], float(w[-1]))


def _dense(texts: pa.Array, features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(features)), "f4")
    for at, run in _runs(texts):
        rows, columns = present(run, features)
        out[at + rows, columns] = 1
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most per_class documents and most_bytes of whole texts of each label, the first by hash of their id; no held-out row.

    Of rows that share a sampled id one stays, so repeated ids crowd out no other document.
    """
    each = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = each.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [each.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * per_class rows
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("x"))
    size = F.coalesce(F.octet_length("x.text"), F.lit(0)).cast("long")
    so_far = F.sum(size).over(Window.partitionBy("x.toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # over per_class rows at most
    fit_in = one.withColumn("_so_far", so_far).where((F.col("_so_far") <= most_bytes) | (F.col("_so_far") == size))
    return fit_in.select("doc_id", "x.text", "x.toxic").orderBy("doc_id")


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The model of the labelled sample, fit by one task: the sample is bounded, and the driver gets the weights alone."""
    named = docs.select("doc_id", F.col(*quoted([text])).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").fill_null("").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        model = fit(texts, toxic)
        yield pa.RecordBatch.from_pydict({"features": [model.features.view("i8")], "weights": [model.weights], "bias": [model.bias]})

    sample = labelled_sample(named, labels).repartition(1).sortWithinPartitions("doc_id")
    told = sample.select("text", "toxic").mapInArrow(run, "features array<long>, weights array<double>, bias double").first()
    if told is None:  # no sample, no task
        return fit([], [])
    return Model(np.array(told["features"], "i8").view("u8"), np.array(told["weights"], "f8"), told["bias"])


def score(df: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns and the score of each whole text."""
    schema = df.select(*quoted(list(keep))).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            scores = pa.array(model.scores(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], names=[*keep, "score"])

    return df.select(*quoted(list(dict.fromkeys([*keep, "text"])))).mapInArrow(run, schema)


def drop_toxic(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose text scores below 0.5, with df's own columns, whatever their names."""
    model, place = train(df, labels, text), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, f"c{place}", SLICE):
            yield batch.filter(pa.array(model.scores(batch.column(place)) < 0.5))

    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names with dots cannot pass the worker
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
