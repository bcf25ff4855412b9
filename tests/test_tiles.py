"""Samples-by-samples products in tiles, and the choice of components from strips, against whole matrices."""

from __future__ import annotations

import numpy as np
import pytest

from sparsegeno.functions import passes
from sparsegeno.functions.passes import collect_matrix
from sparsegeno.operators import covariance, frequency, pca


def vectors(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "site_idx long, e array<double>").repartition(5)


@pytest.mark.parametrize("tile", [1, 7, 10, 23, 64])
def test_products_in_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(passes, "CELLS", 23 * 4)  # batches of four sites
    x = np.random.default_rng(5).normal(size=(31, 23))
    rows = vectors(spark, x)
    assert np.allclose(collect_matrix(covariance.gram(rows, tile=tile)), x.T @ x)
    assert np.allclose(collect_matrix(covariance.gram(rows, mean=True, tile=tile)), x.T @ x / 31)
    strips = passes.tile_sums(rows, lambda c: (c["e"], c["e"].sum(axis=0)), tile).collect()
    assert len(strips) == 23 * -(-23 // tile) and {r["sites"] for r in strips} == {31}
    assert max(len(r["v"]) for r in strips) == min(tile, 23)
    want = x.T @ x
    np.fill_diagonal(want, x.sum(axis=0))
    for r in strips:
        assert np.allclose(r["v"], want[r["i"], r["j0"] : r["j0"] + tile])


def test_no_task_holds_more_than_a_tile(spark):
    """5,000 samples: the parts of E that a pair of tiles gets, and what is passed on, have the size of tiles and strips."""
    samples, tile = 5000, 700
    x = np.random.default_rng(1).normal(size=(6, samples))
    strips = passes.tile_sums(vectors(spark, x), lambda c: (c["e"], None), tile)
    found = strips.selectExpr("max(size(v)) AS widest", "count(*) AS n", "count(DISTINCT i) AS rows").first()
    assert tuple(found) == (tile, samples * 8, samples)
    for i in (0, 699, 700, 4999):
        parts = {r["j0"]: r["v"] for r in strips.where(f"i = {i}").collect()}
        assert np.allclose(np.concatenate([parts[j] for j in sorted(parts)]), x[:, i] @ x)


def test_empty_and_narrow(spark):
    none = vectors(spark, np.zeros((1, 3))).where("site_idx < 0")
    assert covariance.gram(none, tile=2).count() == 0
    one = vectors(spark, np.array([[2.0]]))
    assert collect_matrix(covariance.gram(one, tile=2)).tolist() == [[4.0]]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    f = rng.uniform(0.1, 0.9, (120, 3))[:, [0] * 6 + [1] * 6 + [2] * 7]
    g = rng.binomial(2, f)
    like = np.full((*g.shape, 3), 0.05)
    for k in range(3):
        like[..., k] += (g == k) * 0.85
    rows = [(i, like[i, :, 0].tolist(), like[i, :, 1].tolist()) for i in range(len(g))]
    sites = spark.createDataFrame(rows, "site_idx long, l0 array<double>, l1 array<double>").repartition(3)
    return frequency.filter_maf(frequency.em_steps(sites, 5)).cache()


def test_covariances_in_tiles(panel):
    for tile in (4, 19):
        assert np.allclose(collect_matrix(covariance.covariance(panel, tile=tile)), collect_matrix(covariance.covariance(panel)))
        model = pca.fit_pi(panel, 2, fixed_rounds=2).panel
        assert np.allclose(
            collect_matrix(covariance.covariance(model, "pi", tile=tile)), collect_matrix(covariance.covariance(model, "pi"))
        )
        assert np.allclose(
            collect_matrix(covariance.pi_covariance(model, tile=tile)), collect_matrix(covariance.pi_covariance(model))
        )


def test_components_from_strips(spark, panel):
    """The same number as from the whole matrix, on random covariances of one to six groups of samples."""
    assert pca.choose_components(panel, direct=0, tile=5) == pca.choose_components(panel)
    rng, seen = np.random.default_rng(9), set()
    for i in range(12):
        samples, groups, sites = int(rng.integers(12, 45)), 1 + i % 6, 400
        means = rng.normal(size=(sites, groups)) * rng.uniform(0.3, 1.5)
        x = means[:, rng.integers(0, groups, samples)] + rng.normal(size=(sites, samples))
        c = x.T @ x / sites
        c[np.diag_indices(samples)] *= rng.uniform(0.9, 1.3)
        rows = [
            (r, j, (c[r, j : j + 8] * 3).tolist(), 3) for r in range(samples) for j in range(0, samples, 8)
        ]
        strips = spark.createDataFrame(rows, passes.STRIP).repartition(3).cache()
        want = pca.select_k(c)
        assert pca.select_components(strips, samples) == want
        seen.add(want)
        strips.unpersist()
    assert len(seen) > 2


def test_residual_variance_of_zero(spark):
    """A component that leaves no variance scores 1 in both forms."""
    c = np.outer(np.arange(1.0, 6), np.arange(1.0, 6)) + np.diag([0.0, 0, 0, 0, 2.0])
    strips = spark.createDataFrame([(i, 0, c[i].tolist(), 1) for i in range(5)], passes.STRIP)
    assert pca.select_components(strips, 5) == pca.select_k(c)


def test_rounding_chooses_nothing(spark):
    """Covariances of few dimensions: with one left the score is exactly 1, with none it is 1 by definition, whatever rounding says."""
    rng = np.random.default_rng(4)
    for rank, samples in ((1, 5), (2, 5), (2, 30), (3, 12), (3, 40), (4, 25)):
        x = rng.normal(size=(rank, samples)) * 2.0 ** -np.arange(rank)[:, None]
        c = x.T @ x
        values, vectors = np.linalg.eigh(c)
        scores = []
        for e in range(1, rank - 1):
            rest = c - (vectors[:, -e:] * values[-e:]) @ vectors[:, -e:].T
            d = np.diag(rest)
            scores.append(((rest**2 / np.outer(d, d)).sum() - samples) / (samples * (samples - 1)))
        want = int(np.argmin([*scores, 1.0])) + 1
        rows = [(i, j, c[i, j : j + 8].tolist(), 1) for i in range(samples) for j in range(0, samples, 8)]
        strips = spark.createDataFrame(rows, passes.STRIP)
        assert (pca.select_k(c), pca.select_components(strips, samples)) == (want, want)
    found = [pca._first_smallest(x) for x in ([0.5, 0.2, 0.2 * (1 - 1e-13), 0.2], [0.2, 0.2 - 1e-8], [0.1, -1e-17, 0.1])]
    assert found == [2, 2, 2]


def test_unsettled_vectors_are_reported(monkeypatch):
    monkeypatch.setattr(pca, "MOST_PASSES", 1)
    c = np.diag(np.linspace(1, 2, 60))
    with pytest.warns(RuntimeWarning, match="residual"):
        pca.lanczos(lambda q: c @ q, 60, 3)


def test_no_rounds_are_the_population_model(panel):
    model = pca.fit_pi(panel, 1, most_rounds=0)
    assert (model.rounds, model.converged) == (0, False)
    for r in model.panel.collect():
        assert r["pi"] == [r["f"]] * 19
    assert np.allclose(collect_matrix(model.cov), collect_matrix(covariance.covariance(panel)))
