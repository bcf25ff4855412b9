"""What fits share: sites are dealt once, stages go on where the last one ended, and a round needs few sums."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegeno.operators import admixture

SAMPLES, SITES = 6, 80


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    f, q = rng.uniform(0.1, 0.9, (SITES, 2)), rng.dirichlet((0.5, 0.5), SAMPLES)
    x = np.clip(f @ q.T + rng.normal(0, 0.05, (SITES, SAMPLES)), 1e-3, 1 - 1e-3)
    like = rng.dirichlet((1, 1, 1), (SITES, SAMPLES))
    rows = [(i, like[i, :, 0].tolist(), like[i, :, 1].tolist(), x[i].tolist()) for i in range(SITES)]
    return spark.createDataFrame(rows, "site_idx long, l0 array<double>, l1 array<double>, pi array<double>").repartition(3)


def test_search_works_its_panel_out_once(spark, panel):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = panel.mapInArrow(run, panel.schema)
    with admixture.fits_over(counted, SAMPLES, 2, most_rounds=4) as fits:
        admixture.alpha_search(fits, 10.0, 4)
    assert seen.value == SITES


def test_stages_go_on(spark, panel):
    """Many short stages give what a single one gives."""
    options = {"tol": 0.0, "most_rounds": 7, "batches": 3, "tasks": 3}
    one = admixture.admix_many(panel, SAMPLES, 2, [0.0, 4.0], **options)
    many = admixture.admix_many(panel, SAMPLES, 2, [0.0, 4.0], rounds_per_stage=2, seconds_per_stage=0.0, **options)
    for a, b in zip(one, many, strict=True):
        assert a.rounds == b.rounds == 7
        assert np.allclose(a.q, b.q, atol=1e-12) and a.log_likelihood == pytest.approx(b.log_likelihood)
        anc = [np.array([r["anc"] for r in x.panel.orderBy("site_idx").collect()]) for x in (a, b)]
        assert anc[0].shape == (SITES, 2) and np.allclose(*anc, atol=1e-12)


def test_a_steady_round_needs_a_sum_per_batch():
    rng = np.random.default_rng(1)
    xs = [rng.uniform(0.05, 0.95, (50, SAMPLES)) for _ in range(4)]
    q = rng.dirichlet((1, 1), SAMPLES)
    fit = admixture._Fit(0.0, q, [rng.uniform(0.1, 0.9, (2, 50)) for _ in xs], 0, False)
    calls = []

    class Alone:
        rank = 0

        def __call__(self, *parts):
            calls.append(len(parts))
            return [np.array(p, float) for p in parts]

    admixture._rounds([fit], xs, np.full(4, 50), 200, (1000, 0.0), 0.0, Alone())
    assert fit.rounds == 200 and len(calls) < 1.5 * 200 * len(xs)


def test_a_task_without_sites_of_a_batch():
    """Fewer sites than tasks and batches: sums still have the shapes of the other tasks."""
    fit = admixture._Fit(0.0, np.full((SAMPLES, 2), 0.5), [np.zeros((2, 0))], 0, False)
    shapes = []

    def sums(*parts):
        shapes.extend(np.shape(p) for p in parts)
        return [np.ones(np.shape(p)) / (1 + np.arange(np.size(p)) * 100.0).reshape(np.shape(p)) for p in parts]

    fx, ff = admixture._anc_steps([fit], 0, np.zeros((0, SAMPLES)), 4, sums, admixture._Room())[0]
    assert fx.shape == (2, SAMPLES) and ff.shape == (2, 2) and (2, SAMPLES) in shapes
