"""Sinks at the edges: what is rounded once, and what is worked out once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparsegeno.jobs import run
from sparsegeno.jobs.queries import QUERIES
from sparsegeno.operators.fixed_point import Fit
from sparsegeno.sources import files, reads, sinks


def test_null_model_is_rounded_once(spark, sf_dir, monkeypatch):
    """0.12344998 is 0.1234, though with seven digits it is 0.1234500."""
    found = {"inbreed": -0.12344998, "lrt": 1.23449998}
    monkeypatch.setattr(run.inbreeding, "per_site", lambda panel, tol, rounds: Fit(panel.withColumn("inbreed", F.lit(found["inbreed"])), 1, True))
    monkeypatch.setattr(run.inbreeding, "likelihood_ratios", lambda panel: panel.withColumn("lrt", F.lit(found["lrt"])))
    rows = QUERIES["sink_null_model"](spark, sf_dir).select("f", "t").distinct().collect()
    assert [tuple(r) for r in rows] == [(-0.1234, 1.234)]


def counted(spark, sites: int, column: str):
    """A panel that counts how often each of its sites is worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(sites).select((F.col("id") * 7 % 1009 * 1000).alias("site_idx"), F.array(F.col("id") / 7.0, F.lit(0.5)).alias(column))
    return rows.mapInArrow(run, f"site_idx long, {column} array<double>"), seen


def test_npy_works_its_panel_out_once(spark, tmp_path):
    panel, seen = counted(spark, 1009, "e")
    places = sinks.write_npy(panel, "e", f"{tmp_path}/e.npy", "<f8")
    back = files.read_npy_at(places, f"{tmp_path}/e.npy").collect()
    assert seen.value == 1009
    want = {i * 7 % 1009 * 1000: [i / 7.0, 0.5] for i in range(1009)}
    assert {r["site_idx"]: r["values"] for r in back} == want and len(back) == 1009
    whole = np.load(f"{tmp_path}/e.npy")
    assert whole.tolist() == [want[s] for s in sorted(want)]
    assert [r["pos"] for r in places.orderBy("site_idx").collect()] == list(range(1009))


def test_grouped_panel_deals_reads_out_once(spark, sf_dir):
    """Lines are shuffled to their orders and to their sites, and nowhere else."""
    panel = reads.grouped_panel(reads.star_reads(spark, sf_dir), reads.sample_regions(spark, sf_dir))
    plan = panel._jdf.queryExecution().executedPlan().toString()
    by_site = [x for x in plan.split("\n") if "Exchange hashpartitioning(site_idx" in x]
    assert len(by_site) == 1 and "sample_idx" not in by_site[0].split("]")[0].split("hashpartitioning")[1].split(")")[0]
    assert plan.count("lineitem.parquet") <= 1 and panel.count() == 200


def test_npy_takes_few_jobs(spark, sf_dir):
    """What the driver keeps grows with jobs and plans; ranking sites twice over a panel worked out anew took several times as many."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("npy", "")
    rows = QUERIES["sink_pi_npy"](spark, sf_dir).collect()
    jobs = len(tracker.getJobIdsForGroup("npy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 200 * 25 and jobs < 40
