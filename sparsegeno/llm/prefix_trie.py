"""Prefix trie of conversations by collapsing whole sequences.

Conversations are rebuilt, equal ones become one weighted sequence with the list of the
conversations that end there, sequences that are a proper prefix of another one are told from leaves by
an anti-join, and the weights are added up over the prefixes of what is left.

A prefix is known by 120 bits: the exclusive or of a keyed digest (SHA-256) of each of its turns with the turn's
place, under a key drawn for each run. So a prefix's parent follows from its own row, and the prefixes of a
conversation come from sums in blocks of its turns: no conversation has to be held, sorted or hashed as a whole, and
turns are numbered by a range-partitioned sort. Sums over a node's subtree use that each node is owned by the first leaf
below it: suffix sums of the owned values along each leaf's sequence, added up by node, count every node once.
Lists of ends are joined in runs of bounded length before they meet, and digested as a stream.

Defined results: null roles and texts are empty; rows without conv_id belong to no conversation and are left out;
turns with equal numbers are ordered by role and digest of the text, so repeated rows are repeated turns; conv_id % 5 has the
sign of conv_id. Extra columns are ignored. No rows give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Conversations of a family take up to MOST - 1 turns from the one whose id is divisible by FAMILY.
FAMILY, MOST = 5, 9
#: Turns of a conversation that are summed up in one window; ids of ends that are joined to one text.
BLOCK, RUN = 1024, 8192

KEY = ["d", "ka", "kb"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, content, size): every turn with its place, from 0, in its conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        role.alias("role"),
        F.sha2(F.concat_ws(":", F.length(role), role, text), 256).alias("content"),
        F.octet_length(text).cast("long").alias("size"),
    )
    schema = "conv long, content string, size long, part long, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            begins = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
            lengths = np.diff(np.concatenate((begins, [len(conv)])))
            nth = np.arange(len(conv)) - np.repeat(begins, lengths)
            if conv[0] == last:
                nth[: lengths[0]] += seen
            last, seen = conv[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), part)), pa.array(nth)],
                ["conv", "content", "size", "part", "nth"],
            )

    keys = ["conv", "turn", "role", "content"]
    ordered = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "content", "size")
    placed = written(ordered.mapInArrow(run, schema), "trie-turns")
    # one row per partition of the sort: how many turns of its first conversation came before
    ends = placed.groupBy("part").agg(F.min("conv"), F.max(F.struct("conv", "nth")).alias("last")).orderBy("part").collect()
    carried, conv, count = [], None, 0
    for part, first, (last, nth) in ends:
        before = count if first == conv else 0
        carried.append((part, first, before))
        conv, count = last, nth + 1 + (before if first == last else 0)
    if not carried:
        return placed.selectExpr("conv", "nth AS pos", "content", "size")
    carried = F.broadcast(placed.sparkSession.createDataFrame(carried, "part long, first long, before long"))
    return placed.join(carried, "part").select(
        "conv", (F.col("nth") + F.when(F.col("conv") == F.col("first"), F.col("before")).otherwise(0)).alias("pos"), "content", "size"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, m, d, content, size), d from 1, of every rebuilt conversation, and (conv, m) with its number of turns."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = convs.select(
        "conv",
        "n",
        (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST).alias("h"),
        (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
    )
    convs = written(convs, "trie-conversations")
    there = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    own = F.col("conv") == F.col("base")
    taken = F.when(own, 0).otherwise(F.least("h", F.coalesce("n_base", F.lit(0)))).alias("taken")
    skip = F.when(own, 0).otherwise(F.col("h")).alias("skip")
    convs = convs.join(there, "base", "left").select("conv", "n", "base", taken, skip)
    convs = convs.withColumn("m", F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0)))
    convs = written(convs, "trie-families")
    kept = (
        turns.join(convs.select("conv", "taken", "skip", "m"), "conv")
        .where("pos >= skip")
        .select("conv", "m", (F.col("pos") - F.col("skip") + F.col("taken") + 1).alias("d"), "content", "size")
    )
    # a conversation has few relatives, and they take few turns
    heads = turns.where(F.col("pos") < MOST - 1).select(F.col("conv").alias("base"), "pos", "content", "size")
    lent = (
        convs.where("taken > 0")
        .select("conv", "base", "taken", "m")
        .join(heads, "base")
        .where("pos < taken")
        .select("conv", "m", (F.col("pos") + 1).alias("d"), "content", "size")
    )
    return kept.unionByName(lent), convs.select("conv", "m")


def _running(rows: DataFrame, block: int, sums: dict[str, Column], values: list[str], backwards: bool = False) -> DataFrame:
    """``rows`` of (conv, d) with running sums: inside blocks of a conversation first, then over its blocks."""
    rows = rows.withColumn("block", F.expr(f"d div {block}"))
    order = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    inside = Window.partitionBy("conv", "block").orderBy(order("d")).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.groupBy("conv", "block").agg(*(f.alias(f"{k}_0") for k, f in sums.items()))
    before = Window.partitionBy("conv").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {k: F.bit_xor if k != "sum" else F.sum for k in sums}
    part = part.select(
        "conv", "block", *(F.coalesce(kinds[k](f"{k}_0").over(before), F.lit(0)).alias(f"{k}_0") for k in sums)
    )
    rows = rows.select("conv", "d", "block", *values, *(f.over(inside).alias(k) for k, f in sums.items()))
    rows = rows.join(part, ["conv", "block"])
    plus = {k: F.col(k).bitwiseXOR(F.col(f"{k}_0")) if k != "sum" else F.col(k) + F.col(f"{k}_0") for k in sums}
    return rows.select("conv", "d", *values, *(c.alias(k) for k, c in plus.items()))


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, m, d, ka, kb, ea, eb, size): every prefix of every conversation; the parent's key is the key without its last turn."""
    key = secrets.token_hex(16)
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.col("d"), F.col("content")), 256)
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = written(turns.select("conv", "m", "d", "size", half[0].alias("ea"), half[1].alias("eb")), "trie-elements")
    sums = {"ka": F.bit_xor("ea"), "kb": F.bit_xor("eb")}
    return written(_running(rows, block, sums, ["m", "size", "ea", "eb"]), "trie-prefixes")


def ends_digest(ends: DataFrame, run_length: int = RUN) -> DataFrame:
    """(d, ka, kb, ends_sha256): digest of the ascending ids that end at each node, from texts of a run of ids each."""
    at = F.expr(f"conv div {run_length}").alias("run")  # around 0 two runs in one
    runs = ends.groupBy(*KEY, at).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    runs = runs.select(*KEY, "run", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(done):
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k], pa.int64()) for k in done), pa.array([state.hexdigest()])], [*KEY, "ends_sha256"]
            )

        for batch in batches:
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == key:
                    state.update(b",")
                else:
                    if key:
                        yield out(key)
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
        if key:
            yield out(key)

    return runs.mapInArrow(digest, "d long, ka long, kb long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, run_length: int = RUN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(numbered(conversations))
    rows = prefixes(turns, block)
    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    ends = rows.where("d = m").select("conv", *KEY).unionByName(convs.where("m = 0").select("conv", *zero))
    ends = written(ends, "trie-ends")
    # whole sequences, and whether they go on in another one
    whole = ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv").alias("conv"))
    parent = [(F.col("d") - 1).alias("d"), F.col("ka").bitwiseXOR(F.col("ea")).alias("ka"), F.col("kb").bitwiseXOR(F.col("eb")).alias("kb")]
    proper = written(rows.select(*parent).distinct(), "trie-proper")
    whole = written(whole, "trie-whole")
    leaves = whole.join(proper, KEY, "left_anti").select("conv", F.lit(True).alias("leaf"))
    whole = whole.join(leaves, "conv", "left").select(
        "conv", "weight", F.coalesce("leaf", F.lit(False)).alias("leaf")
    )
    whole = written(whole, "trie-weighted")
    nothing = [F.lit(0).cast("long").alias(k) for k in ("size", "ea", "eb")]
    weighted = rows.join(whole, "conv").select("conv", *KEY, "size", "ea", "eb", "weight", "leaf")
    weighted = weighted.unionByName(whole.select("conv", *zero, *nothing, "weight", "leaf"))
    weighted = written(weighted, "trie-rows")
    nodes = weighted.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"),
        F.min("conv").alias("conv_id"),
        *(F.max(c).alias(c) for c in ("size", "ea", "eb")),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv"))).alias("owner"),
    )
    nodes = written(nodes, "trie-nodes")
    # what a node saves is laid on the sequence of its owner, and summed up from the end of each sequence
    saved = nodes.select(F.col("owner").alias("conv"), "d", ((F.col("n_convs") - 1) * F.col("size")).alias("v"))
    along = weighted.where("leaf").select("conv", *KEY).join(saved, ["conv", "d"], "left").fillna(0, ["v"])
    along = _running(written(along, "trie-saved"), block, {"sum": F.sum("v")}, ["ka", "kb"], backwards=True)
    sums = along.groupBy(*KEY).agg(F.sum("sum").alias("saved_tokens"))
    children = nodes.where("d > 0").select(*parent).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(sums, KEY).join(children, KEY, "left").join(ends_digest(ends, run_length), KEY, "left")
    nodes = written(nodes, "trie-summed")
    above = nodes.select(*(F.col(k).alias(f"p_{k}") for k in KEY), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.withColumns({f"p_{k}": c for k, c in zip(KEY, parent, strict=True)})
    return below.join(above, [f"p_{k}" for k in KEY], "left").select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
