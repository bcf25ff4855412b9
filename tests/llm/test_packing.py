"""Packing against the tokenizers library and a plain deficit round-robin that loops over rounds."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsegeno.llm import packing

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return packing.WordEncoder(path), found


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abetsrABÀéß'.,;!19 \t\n\x1c\x85\u0301\u0130Σσ中🙂<|>\x00"), max_size=60))
def test_words_random(library, text):
    mine, theirs = library
    assert np.frombuffer(mine.encode([text])[0], mine.dtype).tolist() == ids_of(theirs, text)


def test_words_long(library, monkeypatch):
    mine, theirs = library
    monkeypatch.setattr(packing, "SLAB", 50)
    monkeypatch.setattr(packing, "AT_ONCE", 120)
    monkeypatch.setattr(packing, "MEMO_WORDS", 40)
    texts = [" ".join(f"Word{i}. é{i}x don't {'ab' * (i % 30)}" for i in range(100)), "", "x" * 500, "<|endoftext|> a\tb"]
    got = [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode(texts)]
    assert got == [ids_of(theirs, t) for t in texts]


def check_pieces(rows, want, window=2048):
    """Pieces cover each document's ids once and fill each sequence but the last; want: ids by doc_id, a list for each row."""
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert sorted(sequences) == list(range(len(sequences)))
    used = []
    for i in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[i]):
            assert offset == at and length > 0
            at += length
        used.append(at)
    assert all(n == window for n in used[:-1]) and (not used or 0 < used[-1] <= window)
    assert set(parts) == set(want)
    for doc, lists in want.items():
        assert sum(x[1] for x in parts[doc]) == sum(map(len, lists))
        if len(lists) == 1:
            ids, at = np.array(lists[0], "<u4"), 0
            for start, length, crc, n in sorted(parts[doc]):
                assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length


def test_real_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(5)).collect()
    want = {r["doc_id"]: [ids_of(library[1], r["text"])] for r in docs.select("doc_id", "text").collect()}
    check_pieces(rows, want)
    # every sequence holds every source near its share, and what was sent never strays
    held = collections.Counter()
    per = collections.defaultdict(collections.Counter)
    for r in rows:
        held[r["source"]] += r["length"]
        per[r["sequence_id"]][r["source"]] += r["length"]
    total, sent = sum(held.values()), collections.Counter()
    for i in sorted(per)[:-1]:
        sent += per[i]
        for source, n in held.items():
            quantum = 2048 * n / total
            assert abs(per[i][source] - quantum) <= 2 * max(128, quantum)
            assert abs(sent[source] - (i + 1) * quantum) <= 2 * max(128, quantum)


def round_robin(queues, quanta, grain):
    """Packets in the order in which plain deficit round-robin sends them; queues: name to number of tokens."""
    heads, at, deficit, out, turn = {}, dict.fromkeys(queues, 0), dict.fromkeys(queues, 0.0), [], 0
    for name, n in queues.items():
        size = max(quanta[name], float(grain))
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(min(n, math.floor(len(cuts) * size)))
        heads[name] = cuts
    while any(at[x] < len(heads[x]) - 1 for x in queues):
        turn += 1
        for name in sorted(queues):
            deficit[name] = turn * quanta[name] - heads[name][at[name]]  # earned so far without what was sent
            while at[name] < len(heads[name]) - 1:
                a, b = heads[name][at[name] : at[name] + 2]
                if b - a > deficit[name] + 1e-6:
                    break
                deficit[name] -= b - a
                out.append((turn, name, a, b - a))
                at[name] += 1
    return out


@pytest.mark.parametrize("targets", [None, {"a": 0.2, None: 0.5}])
def test_order_is_that_of_round_robin(spark, library, targets):
    sizes = {"a": [700, 3, 90, 4000], "b": [5, 5, 5], "c": [12_000], None: [1, 300, 2]}
    docs = [(100 * i + j, "0 " * (n - 1), s) for i, (s, x) in enumerate(sizes.items()) for j, n in enumerate(x)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    ids = packing.tokens(df)
    credit = packing.queues(ids, 256, targets)
    quanta = {r["queue"]: r["quantum"] for r in credit.collect()}
    held = {"" if s is None else f"={s}": sum(x) for s, x in sizes.items()}
    share = {k: n / sum(held.values()) for k, n in held.items()}
    if targets:
        share |= {"=a": 0.2, "": 0.5}
    for k, x in share.items():
        assert quanta[k] == pytest.approx(256 * x / sum(share.values()))
    got = packing.packets(ids, credit, 64).orderBy("round", "queue", "place").collect()
    merged = collections.OrderedDict()
    for r in got:
        key = r["round"], r["queue"]
        merged.setdefault(key, [r["place"], 0])
        assert r["place"] == sum(merged[key])
        merged[key][1] += r["length"]
    want = collections.OrderedDict()
    for turn, name, a, n in round_robin(held, quanta, 64):
        want.setdefault((turn, name), [a, 0])
        want[turn, name][1] += n
    assert list(merged.items()) == list(want.items())
    rows = packing.pack(df, window=256, grain=64, targets=targets).collect()
    check_pieces(rows, {i: [ids_of(library[1], t)] for i, t, _ in docs}, 256)


def test_odd_inputs(odd_docs, no_docs, library):
    want = collections.defaultdict(list)
    for doc, text, *_ in ODD:
        want[doc].append(ids_of(library[1], text))
    rows = packing.pack(odd_docs).collect()
    check_pieces(rows, want)
    assert packing.pack(no_docs).collect() == []
    n = packing.mixture(packing.pack(odd_docs)).groupBy().sum("n_tokens").first()[0]
    assert n == sum(len(x) for lists in want.values() for x in lists)
    with pytest.raises(ValueError, match="positive"):
        packing.pack(odd_docs, targets={"s1": 0})
