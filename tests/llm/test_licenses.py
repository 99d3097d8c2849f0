"""Anchors of licence notices: no text that matches a notice is without one."""

from __future__ import annotations

import random
import re

import pytest

from tallybook.llm.licenses import NOTICES, anchors


def words_of(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def bigrams(words):
    return set(zip(words, words[1:], strict=False))


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("licence", NOTICES)
def test_what_has_no_anchor_does_not_match(licence, percent):
    rng = random.Random(licence)
    template = words_of(NOTICES[licence])
    own, found = bigrams(template), anchors(NOTICES[licence], percent)
    assert found <= set(template)
    for _ in range(2_000):
        kept = [w for w in template if w not in found or rng.random() < 0.2]
        for _ in range(rng.randrange(3)):
            kept.insert(rng.randrange(len(kept) + 1), rng.choice(["x", "y", *template]))
        pairs = bigrams(kept)
        if pairs and 200 * len(pairs & own) >= percent * (len(pairs) + len(own)):
            assert found & set(kept)


def test_texts_that_match_have_an_anchor():
    for notice in NOTICES.values():
        assert anchors(notice, 80) & set(words_of(notice))
    assert anchors("one", 80) == {"one"} and anchors("", 80) == {""}
