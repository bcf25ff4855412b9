"""Graphs that are small beside the session's shuffle partitions."""

from __future__ import annotations

import random
import uuid
from contextlib import contextmanager

import pytest

from sparsegeno.llm import connected


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


PARTS = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def plain(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {x: find(x) for x in top}


def made(seed):
    rng = random.Random(seed)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    star = [("hub", f"s{i}") for i in range(60)]
    loose = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)]
    edges = [rng.choice(((a, b), (b, a))) for a, b in chain + star + loose]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("most", [20_000, 30, 3])
def test_components_in_one_partition_or_many(spark, monkeypatch, most):
    monkeypatch.setattr(connected, "EDGES", most)
    edges = made(most)
    with settings(spark, **PARTS):
        got = connected.components(spark.createDataFrame(edges, "a string, b string").repartition(7)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got} == plain(edges)


def test_rounds_over_a_small_graph_are_few_tasks(spark):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    edges = spark.createDataFrame(made(1), "a string, b string")
    with settings(spark, **PARTS):
        sc.setJobGroup(group, "small graph")
        try:
            connected.components(edges).count()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
    tasks = sum(x.numTasks for x in map(seen.getStageInfo, stages) if x)
    assert 0 < tasks < 400
