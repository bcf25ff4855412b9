"""Exact medians of many columns at once, and robust distances against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from sparsegeno.operators import scans


def sites(spark, z):
    rows = [(i, v.tolist(), "kept") for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "site_idx long, pcadapt array<double>, note string").repartition(4).cache()


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1001])
def test_medians(spark, n):
    rng = np.random.default_rng(n)
    x = np.stack(
        [
            rng.normal(size=n),
            rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
            np.round(rng.normal(size=n)),
            np.zeros(n) * rng.choice([-1, 1], n),
            np.where(np.arange(n) < n // 2, -1e-300, 7.0),
            np.full(n, -3.25),
            rng.choice([np.inf, -np.inf, 1.0], n),
        ],
        axis=1,
    )
    with np.errstate(invalid="ignore"):
        want = np.median(x, axis=0)
        got = scans.medians(sites(spark, x), "pcadapt", lambda z: z)
    assert np.array_equal(got, want, equal_nan=True)


def plain_distances(z):
    def robust(x):
        mid = np.median(x, axis=0)
        return mid, 1.4826022185056018 * np.median(np.abs(x - mid), axis=0)

    k = z.shape[1]
    _, s = robust(z)
    y, u = z / s, np.eye(k)
    for a in range(k):
        for b in range(a):
            plus, minus = robust(y[:, a] + y[:, b])[1], robust(y[:, a] - y[:, b])[1]
            u[a, b] = u[b, a] = (plus**2 - minus**2) / 4
    on = y @ np.linalg.eigh(u)[1]
    mid, width = robust(on)
    return (((on - mid) / width) ** 2).sum(axis=1)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_distances(spark, k):
    rng = np.random.default_rng(k)
    z = rng.normal(size=(700, k)) @ rng.normal(size=(k, k)) + rng.normal(size=k)
    z[:20] += 15  # outliers that must not move the centre
    got = scans.distances(sites(spark, z), components=k)
    assert got.columns == ["site_idx", "pcadapt", "note", "d2"]
    d2 = np.array([r["d2"] for r in got.orderBy("site_idx").collect()])
    assert np.allclose(d2, plain_distances(z), rtol=1e-9)
    one = scans.distances(sites(spark, z[:, :1]), components=1).orderBy("site_idx").collect()
    assert np.allclose([r["d2"] for r in one], (z[:, 0] - np.median(z[:, 0])) ** 2)


def test_jobs_do_not_grow_with_components(spark):
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k in (2, 6):
        rows = sites(spark, np.random.default_rng(k).normal(size=(60, k)))
        spark.sparkContext.setJobGroup(f"distances-{k}", "")
        scans.distances(rows, components=k)
        counts.append(len(tracker.getJobIdsForGroup(f"distances-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] < 80


def test_constant_columns_and_no_sites(spark):
    z = np.stack([np.ones(9), np.arange(9.0)], axis=1)
    d2 = [r["d2"] for r in scans.distances(sites(spark, z), components=2).collect()]
    assert np.isfinite(d2).all()
    none = sites(spark, z).where("site_idx < 0")
    assert scans.distances(none, components=2).count() == 0
