"""Word hashes of the near-duplicate search: no words that collide can be written down."""

from __future__ import annotations

import random

import numpy as np

from sparsegeno.llm import near_dups


def test_thue_morse_words_stay_apart(spark):
    """Two words that a polynomial modulo 2^64 cannot tell apart, whatever its base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    texts = [f"one two three {w} five" for w in (word, other, word)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(rows).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(3)
    words = ["".join(rng.choice("abAB9é.") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 200]))) for _ in range(400)]
    hashes = {}
    for w in words:
        (h,) = near_dups.word_hashes(w)
        lower = w.encode().lower()
        assert hashes.setdefault(lower, h) == h
    assert len(set(hashes.values())) == len(hashes)
    found = near_dups.word_hashes(" \t".join(words) + "\n")
    assert np.array_equal(found, [hashes[w.encode().lower()] for w in words])
    assert len({near_dups.word_hashes("ab" * n)[0] for n in range(1, 200)}) == 199
