"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
Stages 1 and 2 remove documents, stage 3 rewrites texts, stage 4 repeats and leaves out
documents, stage 5 returns one row per document of the mix: doc_id, n_tokens, ids_sha256,
decoded_sha256. All others return the columns of ``documents``.

Null, empty and very long texts, repeated rows, empty tables and extra columns are treated
as each operator's module says. SQL cannot express the boosted trees of stage 3 nor the
merges of stage 5, so there is no SQL for the whole run; tests compare with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsegeno.llm import bpe, mixing, near_dups, personal_data, quality_rules
from sparsegeno.llm.common import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dups.keep(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text."""
    out = personal_data.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to meet their source's target."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded."""
    return bpe.digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal),
    ("mix", mix),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
