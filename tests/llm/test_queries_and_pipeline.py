"""Registered corpus queries against their SQL, and the pipeline against its stages done by hand."""

from __future__ import annotations

import collections
import hashlib

import pandas as pd
import pytest

import corpus_pipeline
from sparsegeno.llm import bpe, mixing, near_dups, personal_data, quality_rules
from sparsegeno.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import WORD, brute_near, brute_quality, brute_targets


def ordered(df):
    cols = sorted(df.columns)
    return df[cols].sort_values(cols).reset_index(drop=True)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = ordered(QUERIES[name](spark, sf_dir).toPandas()), ordered(con.sql(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-3)


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    assert first <= {i for i, t in text.items() if not brute_quality(t)[-1]}
    judged = quality_rules.apply_policy(quality_rules.ledger(docs), "v2").where("kept").collect()
    assert first == {r["doc_id"] for r in judged}
    rows = sorted((i, text[i]) for i in first)
    left = {i for i, _, least in brute_near(rows) if i == least}
    kept = near_dups.keep(docs.where(docs.doc_id.isin(*first)))
    assert {r["doc_id"] for r in kept.collect()} == left
    clean = docs.where(docs.doc_id.isin(*left)).cache()
    spans = {r["doc_id"]: r["spans"] for r in personal_data.detect(clean).collect()}
    redacted = corpus_pipeline.personal(spark, clean, sf_dir).cache()
    without = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert set(without) == left
    for r in redacted.collect():
        assert (r["text"] == text[r["doc_id"]]) == (not spans[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
        assert personal_data.base_spans(r["text"]) == []
    # the mix: targets by handing out again and again, copies by rate and hash
    source = {r["doc_id"]: r["source"] for r in redacted.collect()}
    sizes = collections.Counter()
    for i, t in without.items():
        sizes[source[i]] += len(WORD.findall(t))
    goal, copies = brute_targets(sizes), {}
    for i, s in source.items():
        rate = goal[s] / sizes[s]
        drawn = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48
        copies[i] = int(rate) + (drawn < rate - int(rate))
    mixed = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, redacted, sf_dir).collect())
    assert mixed == collections.Counter({i: n for i, n in copies.items() if n})
    # the whole run: every copy with the digests of its redacted text
    read = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = bpe.Tokenizer(read, public_tokenizers.PATTERN).rank
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in without.items():
        ids = plain.encode_ordinary(t)
        digests = (" ".join(map(str, ids)).encode(), t.encode())
        if copies[i]:
            want[(i, len(ids), *(hashlib.sha256(d).hexdigest() for d in digests))] = copies[i]
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert collections.Counter(tuple(r[n] for n in names) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
