"""Admixture in barrier stages against a plain loop over rounds and batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegeno.functions import barrier
from sparsegeno.operators import admixture

SAMPLES, SITES = 7, 90


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(11)
    f, q = rng.uniform(0.1, 0.9, (SITES, 3)), rng.dirichlet((0.4,) * 3, SAMPLES)
    x = np.clip(f @ q.T + rng.normal(0, 0.05, (SITES, SAMPLES)), 1e-3, 1 - 1e-3)
    like = rng.dirichlet((1, 1, 1), (SITES, SAMPLES))
    return x, like[..., 0], like[..., 1]


@pytest.fixture(scope="module")
def panel(spark, cells):
    x, l0, l1 = cells
    rows = [(i, l0[i].tolist(), l1[i].tolist(), x[i].tolist(), "kept") for i in range(SITES)]
    kinds = "site_idx long, l0 array<double>, l1 array<double>, pi array<double>, batch string"
    return spark.createDataFrame(rows, kinds).repartition(3).cache()


def plain(x, batch, k, alpha, tol, most_rounds, batches, seed=0):
    """Q, anc, rounds and end by a loop that looks at every norm."""
    samples = x.shape[1]
    anc = np.clip(admixture._uniform(np.arange(len(x)), k, seed), 1e-4, 1 - 1e-4)
    q = np.random.default_rng(seed).random((samples, k))
    q /= q.sum(1, keepdims=True)
    for turn in range(1, most_rounds + 1):
        before = q
        for b in range(batches):
            at = np.flatnonzero(batch == b)
            m = len(at)
            if not m:
                continue
            a, gram, first = x[at] @ q, q.T @ q, None
            for _ in range(2 * (1 + (samples * m + samples * k) // (m * k + m))):
                new = np.clip(anc[at] * a / (anc[at] @ gram), 1e-4, 1 - 1e-4)
                norm = np.linalg.norm(new - anc[at])
                anc[at] = new
                first = norm if first is None else first
                if norm <= 0.1 * first:
                    break
            xf, ff, first = x[at].T @ anc[at], anc[at].T @ anc[at], None
            for _ in range(2 * (1 + (samples * m + m * k) // (samples * k + samples))):
                new = np.clip(q * xf / (q @ ff + alpha), 1e-4, 1 - 1e-4)
                new /= new.sum(1, keepdims=True)
                norm = np.linalg.norm(new - q)
                q = new
                first = norm if first is None else first
                if norm <= 0.1 * first:
                    break
        if np.sqrt(((q - before) ** 2).mean()) < tol:
            return q, anc, turn, True
    return q, anc, most_rounds, False


@pytest.mark.parametrize(("batches", "k", "tasks"), [(10, 3, 4), (1, 2, 1), (40, 2, 3)])
def test_equals_a_plain_loop(spark, panel, cells, batches, k, tasks):
    x, l0, l1 = cells
    found = panel.select("site_idx", F.pmod(F.xxhash64("site_idx", F.lit(0)), F.lit(batches)).alias("b")).orderBy("site_idx")
    batch = np.array([r["b"] for r in found.collect()])
    alphas = [0.0, 0.7, 30.0]
    fits = admixture.admix_many(
        panel, SAMPLES, k, alphas, tol=1e-4, most_rounds=60, batches=batches, rounds_per_stage=25, tasks=tasks
    )
    for alpha, fit in zip(alphas, fits, strict=True):
        q, anc, rounds, done = plain(x, batch, k, alpha, 1e-4, 60, batches)
        assert (fit.rounds, fit.converged) == (rounds, done)
        assert np.allclose(fit.q, q, atol=1e-8) and np.allclose(fit.q.sum(1), 1.0)
        got = np.array([r["anc"] for r in fit.panel.orderBy("site_idx").collect()])
        assert np.allclose(got, anc, atol=1e-8)
        p = anc @ q.T
        assert fit.log_likelihood == pytest.approx(np.log(l0 * (1 - p) ** 2 + 2 * l1 * p * (1 - p) + (1 - l0 - l1) * p**2).sum())
        assert fit.frobenius == pytest.approx(np.linalg.norm(p - x))
        assert admixture.log_likelihood(fit.panel, fit.q) == pytest.approx(fit.log_likelihood)
        assert admixture.frobenius(fit.panel, fit.q) == pytest.approx(fit.frobenius)


def test_jobs_do_not_grow_with_rounds(spark, panel):
    """A fit of some rounds in one stage takes as many jobs as one of a single round."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for i, rounds in enumerate((1, 12)):
        spark.sparkContext.setJobGroup(f"fit-{i}", "")
        admixture.admix_many(panel, SAMPLES, 2, [0.0, 1.0, 2.0], tol=0.0, most_rounds=rounds)
        counts.append(len(tracker.getJobIdsForGroup(f"fit-{i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] <= 4


def test_odd_panels(spark, panel):
    few = panel.where("site_idx < 3")
    a = admixture.admix(few, SAMPLES, 2, most_rounds=2, batches=20)
    b = admixture.admix(few, SAMPLES, 2, most_rounds=2, batches=20)
    assert np.array_equal(a.q, b.q) and a.panel.count() == 3 and a.rounds == 2
    none = admixture.admix(panel.where("site_idx < 0"), SAMPLES, 2)
    assert none.panel.count() == 0 and none.converged and none.log_likelihood == 0
    start = admixture.admix(panel, SAMPLES, 2, most_rounds=0)
    assert start.rounds == 0 and not start.converged


def test_slots(spark):
    assert barrier.slots(spark) == 4
