"""The registered queries of the corpus operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, bpe, language, licenses, media, mixing, near_dups, packing, personal_data, prefix_trie, quality_rules, substrings, warc
from .common import table
from .sql import LICENSE_SQL, MIX_SQL, NEAR_SQL, QUALITY_SQL, RANK_SQL, TRIE_SQL, WARC_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detect(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_wav_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_ledger,
        op3_personal_data,
        op4_suffix_dedup,
        op5_byte_bpe,
        op6_language,
        op7_near_duplicates,
        op8_wav_media,
        op9_source_mix,
        op10_warc_round_trip,
        op11_mixture_packing,
        op12_prefix_trie,
        op13_ranked_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": LICENSE_SQL,
    "op2_quality_ledger": QUALITY_SQL,
    "op7_near_duplicates": NEAR_SQL,
    "op9_source_mix": MIX_SQL,
    "op10_warc_round_trip": WARC_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_ranked_search": RANK_SQL,
}
