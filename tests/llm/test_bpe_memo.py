"""What the byte-pair encoder remembers, and the search where the longest entries don't fit."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sparsegeno.llm import bpe


@pytest.fixture()
def pair():
    import public_tokenizers
    import tiktoken

    mine = bpe.Tokenizer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return mine, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.rank, special_tokens={})


def test_words_in_steady_use_are_encoded_once(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "MEMO_PIECES", 50)
    made = Counter()
    one = bpe.Tokenizer.encode_piece

    def counted(self, data):
        made[data] += 1
        return one(self, data)

    monkeypatch.setattr(bpe.Tokenizer, "encode_piece", counted)
    mine = bpe.Tokenizer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    for i in range(500):
        mine.digest(f" often q{i}q{i}")
    assert made[b" often"] == 1
    assert len(mine.pieces) <= 50 and len(mine.pieces.old) <= 50


def test_words_of_syllables(pair):
    """Most of these words need the search: their longest entries don't stand beside each other."""
    mine, theirs = pair
    rng = random.Random(5)
    parts = ["th", "ent", "ä", "ion", "shin", "ble", "ó", "erst", "'", "ou", "anh", "zł", "中", "ndess", " ", "00"]
    searched = 0
    for _ in range(3000):
        text = " " + "".join(rng.choices(parts, k=rng.randint(2, 9)))
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()
        walk = [r for p in mine.split(text) for _, r in mine.automaton.iter_long(p.encode().decode("latin-1"))]
        searched += ids != walk
    assert searched > 300
