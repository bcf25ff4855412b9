"""Ranked search against scoring every document, and bounds against scores."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from sparsegeno.llm import ball_tree

from .conftest import LOREM, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Rows from (doc_id, text) and (item_id, text)."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m, score = 100 - 75 + 75 * n * n_docs // length, 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, **options):
    return sorted(map(tuple, ball_tree.rank(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("text", ["", None, "A_bC-9 é中 Ünï\x7f\x80x", "don't\x00stop ΣΑΣ 🙂"])
def test_terms(text):
    assert [x.decode() for x in ball_tree.terms(text)] == terms(text)


def test_random_search(spark):
    """Skewed words, many ties and copies, small blocks, leaves and groups of queries."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[int(60 * rng.random() ** 2)] for _ in range(n))
    docs = [(rng.choice([i, i, -i]), text(rng.choice([0, 1, 4, 9, 40]))) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w3 same") for i in range(150)] + [(7, "w50 w50"), (None, "w50 w50")]
    items = [(i % 20, text(rng.choice([0, 1, 3, 10, 30]))) for i in range(24)] + [(99, "nowhere"), (98, "same w1 w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert got(d, q, leaf=3, block=40, group_bytes=200) == brute(docs, items)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    for spread in (1, 1000):
        length = rng.integers(1, 12, 3000)
        topic = rng.integers(0, 20, 3000)  # documents of a topic share a range of terms
        rows = [np.unique(rng.integers(50 * t, 50 * t + 50, n)) for t, n in zip(topic, length, strict=True)]
        begin = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        term = np.concatenate(rows)
        vectors = ball_tree.Vectors(begin, term, rng.integers(1, 1 + spread, len(term)) * 1000)
        tree = ball_tree.Tree(vectors, 1000, leaf=8)
        assert sorted(tree.order.tolist()) == list(range(3000))
        ids = rng.permutation(3000)
        for _ in range(20):
            t = rng.integers(0, 20)
            which = np.unique(rng.integers(50 * t, 50 * t + 50, 6))
            weight = rng.integers(1, 9000, len(which))
            query = np.zeros(1000, np.int64)
            query[which] = weight
            scores = vectors.dot(query)
            best, scored = tree.search(which, weight, query, ids, 10, 0)
            assert best == sorted(((int(s), -int(i)) for s, i in zip(scores, ids, strict=True) if s > 0), reverse=True)[:10]
            assert scored < 1500
            floor = best[-1][0] if len(best) == 10 else 0
            assert tree.search(which, weight, query, ids, 10, floor)[0] == best
            todo = [tree.root]
            while todo:
                node = todo.pop()
                if node.sides:
                    todo += node.sides
                else:
                    inside = tree.order[slice(*node.leaf)]
                    assert tree.bound(node, which, weight.astype(float)) >= scores[inside].max()


def test_odd_inputs(spark, odd_docs, no_docs):
    items = [(1, LOREM), (None, "one mail"), (2, None), (3, ""), (4, "x" * 300_000 + " ab"), (5, "é 中文 mit"), (5, "é 中文 mit")]
    extra = spark.createDataFrame([(*x, "a", "b") for x in items], "item_id long, text string, rank string, q string")
    want = brute([(r[0], r[1]) for r in ODD], items)
    assert got(odd_docs, extra) == want
    assert len(want) == 10
    assert got(no_docs, extra) == []
    assert got(odd_docs, extra.limit(0)) == []
