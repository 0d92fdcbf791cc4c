"""Blanks are joined, and inline patterns looked for, without a search of every text by every pattern."""

import random
import re

import pytest

from plectrum.sources import html, markdown


def test_blanks_are_joined_as_the_pattern_says():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b\u2028\u3000\ufeff", k=rng.randrange(12)))
        assert html._spaced(text) == re.sub(r"[\s\ufeff]+", " ", text).strip()


class _Never:
    def sub(self, *_):
        pytest.fail("a text without markup was searched for it")


def test_a_text_without_markup_is_searched_for_none(monkeypatch):
    for name in ("_CODE", "_LINK", "_IMAGE", "_MARKS", "_ESCAPED"):
        monkeypatch.setattr(markdown, name, _Never(), raising=False)
    assert markdown.inline("plain [words] of 3 ~ 4") == "plain [words] of 3 ~ 4"
    assert markdown.nodes("plain words", code=True) == ["plain words"]
    assert [b["text"] for b in markdown.blocks("# T\r\n\rone\ntwo")] == ["T", "one two"]
