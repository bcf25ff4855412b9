"""Connected components of a distributed edge list by alternating large and small stars.

Every round is two joins and two aggregations over edges; nothing is gathered per node, so
a node with very many edges stays spread over tasks. The rounds grow with the logarithm
of the number of nodes. Edges are cut from their lineage in the shared folder each round, and
lie in as many partitions as their number asks for.

Defined results: no edges give no rows; loops and repeated edges change nothing; edges
with a null end are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Edges for each partition: a graph that has shrunk, or was small, doesn't pay for the partitions of its source.
EDGES = 50_000


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """``edges`` with m, the smallest b of their a; ``few`` edges lie in one partition, where a window needs no shuffle."""
    if few:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest node around."""
    both = edges.selectExpr("inline(array(struct(a, b), struct(b as a, a as b)))")
    larger = _with_least(both, few).where("b > a")
    return larger.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = _with_least(down, few).selectExpr("inline(array(struct(b as a, m as b), struct(a, m as b)))")
    return linked.where("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def _parts(count: int) -> int:
    return max(1, -(-count // EDGES))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without edges are absent."""
    edges = cut(edges.where("a != b").select("a", "b").distinct())
    before = _state(edges)
    for _ in range(rounds if before[0] else 0):
        # edges never become more; in one partition they meet without a shuffle
        parts = _parts(before[0])
        edges = edges.coalesce(parts)
        edges = cut(_small_star(_large_star(edges, parts == 1), parts == 1).coalesce(parts))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = edges.coalesce(_parts(before[0]))
    # every edge now leads to the smallest node
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
