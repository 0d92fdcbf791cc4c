"""Terms learned from context, and the trained weights against the objective written out in plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from plectrum.llm import toxicity as t
from plectrum.llm.bytewise import LETTERS, Words


def hashed(word):
    return int(Words(pa.array([word]), LETTERS).hashes()[0])


def corpus(n=900, seed=5):
    """Toxic texts name a group of no list four times in five, clean ones rarely; insults are toxic by themselves."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    texts, toxic = [], []
    for i in range(n):
        bad = i % 3 == 0
        own = rng.choices(words, k=14)
        if rng.random() < (0.7 if bad else 0.05):
            own[rng.randrange(14)] = "zorbans"
        if bad:
            for _ in range(rng.randrange(1, 3)):
                own[rng.randrange(14)] = rng.choice(["vilest", "wretch", "scoundrel"])
        texts.append(" ".join(own))
        toxic.append(int(bad))
    return texts, toxic


def test_a_term_explained_by_its_context_is_learned_and_its_mention_moves_no_score():
    texts, toxic = corpus()
    free, model = t.fit(texts, toxic, penalty=0.0), t.fit(texts, toxic)
    column = pa.array(texts)
    found = t.mentions(column, free.features)
    terms = t.learned_terms(found, free.weights, free.logits(column), np.array(toxic, "f8")).tolist()
    assert hashed("zorbans") in terms and not {hashed(w) for w in ("vilest", "wretch", "scoundrel")} & set(terms)
    pair = pa.array(["abcde zorbans fghab", "abcde cdefg fghab"])
    gap = lambda m: abs(float(np.diff(m.logits(pair))[0]))
    assert gap(free) > 0.3 and gap(model) < 0.25 * gap(free)
    told = lambda m: (m.scores(column) >= 0.5).astype(int)
    assert (told(model) == toxic).mean() > 0.99


def test_stand_ins_are_words_of_like_context_without_weight():
    texts, toxic = corpus()
    free = t.fit(texts, toxic, penalty=0.0)
    found = t.mentions(pa.array(texts), free.features)
    terms = np.array([hashed("zorbans")], "u8")
    words, profile = t.contexts(pa.array(texts), terms, np.unique(found.word))
    assert hashed("vilest") not in words.tolist() and len(words) > 50 and np.allclose(np.linalg.norm(profile, axis=1), 1)
    change = np.concatenate(list(t.learned_changes(pa.array(texts), found, terms, len(free.features) + 1)))
    with_term = sum("zorbans" in x for x in texts)
    assert len(change) == with_term and set(np.unique(change)) == {-1.0, 0.0} and (change.sum(axis=1) < 0).all()
    assert list(t.learned_changes(pa.array(texts), found, terms[:0], 5)) == []
    assert len(t.learned_terms(t.mentions(pa.array(["a"]), free.features), free.weights, np.zeros(1), np.zeros(1))) == 0


def test_weights_minimise_the_objective(monkeypatch):
    """Features, swaps and loss from strings alone: no step in any direction does better than the trained weights."""
    monkeypatch.setattr(t, "TERM_TEXTS", 10**9)  # the listed terms alone
    texts, toxic = corpus(400, 9)
    texts = [x.replace("zorbans", random.Random(i).choice(["muslims", "christians"])) for i, x in enumerate(texts)]
    model = t.fit(texts, toxic)
    place = {int(h): i for i, h in enumerate(model.features)}
    mix = lambda h, i: (h + i) % (1 << 64)

    def present(text):
        out = set()
        for w in re.findall(r"[a-z]+", text.lower()):
            for i, most in enumerate(t.BEGINNINGS):
                out.add(mix(hashed(w if most is None else w[:most]), i))
        return {place[f] for f in out if f in place}

    own = [present(x) for x in texts]
    changes = []
    for x, feats in zip(texts, own, strict=True):
        for row in t.IDENTITY_TERMS:
            for a in row:
                if re.search(rf"\b{a}\b", x):
                    for step in (1, -1):
                        changes.append((feats, present(re.sub(rf"\b{a}\b", row[(row.index(a) + step) % len(row)], x))))
    assert len(changes) > 100

    def loss(w, b):
        out = 0.5 * t.RIDGE * sum(v * v for v in w) + 0.5e-3 * b * b
        for feats, y in zip(own, toxic, strict=True):
            z = b + sum(w[f] for f in feats)
            out += math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z
        moved = sum((sum(w[f] for f in after) - sum(w[f] for f in before)) ** 2 for before, after in changes)
        return out + t.SWAP_PENALTY / len(changes) * len(texts) / 100 * moved

    best = loss(model.weights, model.bias)
    for i in range(len(model.weights)):
        for step in (-0.01, 0.01):
            w = model.weights.copy()
            w[i] += step
            assert loss(w, model.bias) >= best - 1e-9
    assert loss(model.weights, model.bias + 0.01) >= best - 1e-9 and loss(model.weights, model.bias - 0.01) >= best - 1e-9
    assert len(model.weights) > 3
