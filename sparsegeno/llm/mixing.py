"""Mixing sources to target weights: per-source repetition rates, then copies per document.

A document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction. Native: DataFrame functions only.

Defined results: a null or empty text has size 0; a null source is a source of its
own, after all others; a null doc_id draws as the text ''. Rows with equal doc_id draw
alike, so reruns and lost executors change nothing. An empty table gives an empty mix.
Sources with no words have target 0 and rate 0. Extra columns are carried along by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds SHARE percent of all words; no source is repeated more than MOST times.
SHARE, MOST = 150, 2
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sizes: DataFrame) -> DataFrame:
    """From rows (source, size): one row per source with source_size, target and rate.

    Resharing the excess by weight until no source is above its cap ends at
    ``min(cap, level * weight)`` for one common level. Sources sorted by cap / weight
    fill up in that order, so running sums of whole numbers give the level at once.
    The windows run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
    per = per.withColumn("cap", MOST * F.col("source_size"))
    # cap / weight compared as whole numbers: 10 is a multiple of every weight
    scale = 10
    fill = everything.orderBy(F.col("cap") * F.expr(f"{scale} div weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "all": F.sum("source_size").over(everything),
        }
    )
    # level if all sources before this one are full: (SHARE/100 * all - full) / weight_left
    spare = F.col("all") * SHARE - F.col("full") * 100
    holds = spare <= F.col("cap") * F.expr(f"{scale} div weight") * F.col("weight_left") * (100 // scale)
    level = F.min(F.when(holds, F.struct(F.col("full"), F.col("weight_left"), spare.alias("spare")))).over(everything)
    per = per.withColumn("level", level)
    free = (F.col("weight") * F.col("level.spare")).cast("double") / (F.col("level.weight_left") * 100).cast("double")
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), free)
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from the key, the same in every run: 48 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def _with_rates(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Join the rates on; broadcast them if few, else leave the (skew-aware) join to Spark."""
    per = cut(per)
    few = per.count() <= BROADCAST_ROWS
    per = per.select(
        F.coalesce("source", F.lit("")).alias("__src"),
        F.col("source").isNotNull().alias("__has"),
        "source_size",
        "target",
        "rate",
    )
    rows = rows.withColumns({"__src": F.coalesce("source", F.lit("")), "__has": F.col("source").isNotNull()})
    return rows.join(F.broadcast(per) if few else per, ["__src", "__has"]).drop("__src", "__has")


def plan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    sizes = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    out = _with_rates(sizes, rates(sizes)).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
    return out.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 3).alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its source's rate says, columns unchanged."""
    per = rates(docs.select("source", words_in(F.col("text")).alias("size")))
    rated = _with_rates(docs.select(F.struct(*docs.columns).alias("__doc"), "source", "doc_id"), per)
    n = copies(F.col("rate"), F.col("doc_id"))
    out = rated.select("__doc", F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias("__copy"))
    return out.select("__doc.*")
