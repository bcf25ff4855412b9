"""The prefix trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from sparsegeno.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Node rows from (conv_id, turn, role, text)."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 5
        base = c - base
        built[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(map(tuple, prefix_trie.trie(df, **options).collect()), key=str)


def random_rows(rng, n, most):
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, most])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["é", "hm", "", None])))
    rows += rng.sample(rows, 5)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_tries(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 60, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(df) == brute(rows)


def test_copies_and_one_long_conversation(spark):
    """A third of the turns in one conversation, and one sequence with very many ends; small blocks and runs."""
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(700)]
    rows += [(5 * c, t, "user", f"turn {t}") for c in range(1, 200) for t in range(3)]
    rows += [(5 * c + 1, t, "bot", f"own {c % 3}") for c in range(100) for t in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, block=16, run_length=10) == brute(rows)


def test_odd_inputs(spark):
    rows = [
        (None, 1, "user", "nobody's"),
        (7, 0, "user", "only turn, skipped"),
        (10, None, None, None),
        (10, None, None, None),
        (10, 3, "user", "x" * 300_000),
        (11, 2, "user", "\x00 é 中文 🙂"),
        (9_000_000_000_000_000_000, 1, "user", "far"),
        (-9_000_000_000_000_000_000, 1, "user", "far"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", d string, conv string")
    assert got(df) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    turnless = [(c, 0, "u", "t") for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    assert got(spark.createDataFrame(turnless, SCHEMA)) == brute(turnless)
    assert brute(turnless)[0][1] == 0 and len(brute(turnless)) == 1
