import random

import numpy as np
import pytest

from plectrum.llm.bpe import Lexicon, LexiconEncoder, compile_lexicon
from plectrum.llm.tokens import LibraryEncoder, default_path

tokenizers = pytest.importorskip("tokenizers")

ALPHABET = ["a", "b", "the", " ", " ", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "é", "ß", "ñ", "1", "23", "²", "½", "_", "-", "!", "…", "中", "文", "🙂", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "Ω", "е", "́", "ª", "　", "٣"]


def texts(n=4000):
    rng = random.Random(5)
    made = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 14))) for _ in range(n)]
    return ["", " ", "\n", "  x  ", "word", " word", *made]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_path())


def as_list(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pieces_through_the_library_equal_whole_texts(library):
    encoder = LibraryEncoder(default_path())
    encoder.limit = 50  # the memory is cut down again and again
    for a in range(0, len(all_texts := texts()), 100):
        part = all_texts[a : a + 100]
        assert [as_list(x) for x in encoder.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_lexicon_and_merges_equal_the_library_and_decode_back(library):
    merger = LexiconEncoder(default_path(), None).merger
    entries = [(w.encode(), merger.merge(w.encode())) for w in (" the", "the", " thea", "a", " é", "ing", " ing", "\n", "!")]
    encoder = LexiconEncoder(default_path(), Lexicon(compile_lexicon(entries)))
    for a in range(0, len(all_texts := texts()), 100):
        part = all_texts[a : a + 100]
        for text, raw in zip(part, encoder.encode(part), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert as_list(raw) == ids, repr(text)
            assert encoder.decode(np.frombuffer(raw, "<u4")).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_automaton_numbers_every_word_and_shares_suffixes():
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(b"abcd", k=rng.randrange(0, 7))) for _ in range(800)})
    lexicon = Lexicon(compile_lexicon((w, [i, i + 1]) for i, w in enumerate(words)))
    assert [lexicon.find(w) for w in words] == list(range(len(words)))
    assert as_list(lexicon.ids(5)) == [5, 6]
    known = set(words)
    for _ in range(2000):
        w = bytes(rng.choices(b"abcde", k=rng.randrange(0, 9)))
        assert (lexicon.find(w) >= 0) == (w in known)
    few = Lexicon(compile_lexicon((w + b"ending", [0]) for w in (b"a", b"b", b"c", b"d")))
    assert len(few._bytes) == 4 + len(b"ending")
    assert Lexicon(compile_lexicon([])).find(b"x") == -1
