"""Nulls, empty and long texts, repeated rows, clashing columns, empty tables: every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sparsegeno.llm import bpe, language, licenses, media, mixing, near_dups, personal_data, quality_rules, substrings, warc

from .conftest import EXTRA, ODD

OPERATORS = {
    "licenses": licenses.digests,
    "quality": lambda d: quality_rules.apply_policy(quality_rules.ledger(d), "v2"),
    "personal": personal_data.detect,
    "substrings": substrings.deduplicate,
    "bpe": bpe.digests,
    "language": language.classify,
    "near": near_dups.near_duplicates,
    "media": media.digests,
    "mixing": mixing.plan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, odd_docs, no_docs):
    rows = OPERATORS[name](odd_docs).collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    assert ids == sorted((r[0] for r in ODD), key=str)
    assert OPERATORS[name](no_docs).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, odd_docs, no_docs):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, odd_docs, "")
    out.collect()
    if stage != "tokens":
        assert out.columns == odd_docs.columns
        assert set(EXTRA) <= set(out.columns)
    assert run(spark, no_docs, "").count() == 0


def test_long_texts(odd_docs):
    got = {r["doc_id"]: r for r in substrings.deduplicate(odd_docs).collect()}
    assert got[9]["n_removed"] == 300_000 and got[10]["n_removed"] == 360_000
    assert got[2]["n_removed"] == got[2]["n_bytes"]
    assert got[3]["n_bytes"] == 0


def test_pages(spark):
    """Nulls, empty and long pages, magics in payloads, equal payloads and clashing columns."""
    import base64
    import hashlib

    rows = [
        (1, "u", None),
        (2, "u", ""),
        (3, None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20_000),
        (4, "u", "é 中文 🙂 \x00\r\n"),
        (5, "u", "é 中文 🙂 \x00\r\n"),
        (6, "u", "x" * 1_000_000),
    ]
    wide = [(*r, *("clash",) * 4) for r in rows]
    df = spark.createDataFrame(wide, "page_id long, url string, html string, payload string, digest string, file string, at string")
    got = {r["page_id"]: r for r in warc.round_trip(df.repartition(3)).collect()}
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        first.setdefault(data, page)
        r = got.pop(page)
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = first[data] == page
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[data]))
    assert not got
    assert warc.round_trip(df.limit(0)).count() == 0
