"""Cell formulas against plain loops and known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsegeno.functions import kernels as k
from sparsegeno.functions.statistics import chi2_upper
from sparsegeno.operators import admixture, frequency, pca, tree
from sparsegeno.operators.fixed_point import factor, jump


def likelihoods(seed: int, sites: int = 30, samples: int = 7):
    x = np.random.default_rng(seed).dirichlet((1, 1, 1), (sites, samples))
    return x[..., 0], x[..., 1]


def test_em_step_on_hard_calls():
    l0, l1 = np.array([[1.0, 0.0, 0.0]]), np.array([[0.0, 1.0, 0.0]])
    for f in (0.1, 0.5, 0.9):
        assert k.em_step(l0, l1, np.array([f])) == pytest.approx([0.5])


def test_factor_and_jump():
    assert factor(0.25, -0.125) == 2.0
    assert jump(np.array([0.5]), np.array([0.75]), 2.0, 1e-5, 1 - 1e-5) == pytest.approx([1 - 1e-5])
    assert factor(1.0, 0.0) == 1.0
    assert factor(1.0, 1.0) == 1.0
    assert factor(1e9, -1.0) == 256.0


def test_call_ties_and_threshold():
    def one(*w, delta=0.0):
        return int(k.call(tuple(np.array([[x]]) for x in w), delta)[0, 0])

    assert one(0.4, 0.4, 0.2) == 1
    assert one(0.4, 0.2, 0.4) == 2
    assert one(0.2, 0.4, 0.4) == 2
    assert one(0.5, 0.25, 0.25) == 0
    assert one(0.5, 0.25, 0.25, delta=0.5) == -9


def test_inbreeding_of_extremes():
    n = 5
    half = np.full((1, n), 0.5)
    hets = k.heterozygosity(np.zeros((1, n)), np.ones((1, n)), half, np.zeros((1, 1)))
    assert k.inbreeding(hets[0].sum(1), hets[1].sum(1)) == pytest.approx([-1.0])
    homs = k.heterozygosity(np.ones((1, n)), np.zeros((1, n)), half, np.zeros((1, 1)))
    assert k.inbreeding(homs[0].sum(1), homs[1].sum(1)) == pytest.approx([1.0])


def test_posterior_without_inbreeding_is_plain():
    l0, l1 = likelihoods(1)
    p = np.random.default_rng(2).uniform(0.05, 0.95, l0.shape)
    for a, b in zip(k.posterior(l0, l1, p), k.posterior_inbred(l0, l1, p, np.zeros((1, l0.shape[1]))), strict=True):
        assert np.allclose(a, b)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.01, 0.99))
def test_invariants(seed, f):
    l0, l1 = likelihoods(seed, 4, 6)
    p = np.full((4, 1), f)
    assert np.allclose(sum(k.posterior(l0, l1, p)), 1.0, atol=3e-10)
    new = k.em_step(l0, l1, p[:, 0])

    def loglik(q):
        return np.log(sum(k.weights(l0, l1, q[:, None]))).sum(1)

    assert (loglik(new) >= loglik(p[:, 0]) - 1e-12).all()
    swapped = k.em_step(1 - l0 - l1, l1, 1 - p[:, 0])
    assert np.allclose(swapped, 1 - new)


def test_chi2_tail():
    assert chi2_upper(np.array([3.841458820694124]), 1) == pytest.approx([0.05])
    assert chi2_upper(np.array([5.991464547107979]), 2) == pytest.approx([0.05])
    assert chi2_upper(np.array([7.814727903251179]), 3) == pytest.approx([0.05])
    assert chi2_upper(np.array([11.070497693516351]), 5) == pytest.approx([0.05])
    x = np.concatenate([np.linspace(0.0, 60.0, 4001), [200.0, 900.0]])
    want = np.array([math.erfc(math.sqrt(v / 2.0)) for v in x])
    assert np.allclose(chi2_upper(x, 1), want, rtol=1e-11, atol=1e-14)
    assert frequency.hwe_bound(1e-6) == pytest.approx(23.928127, abs=1e-5)


def test_trees():
    newick, _ = tree.neighbour_joining(np.array([[0, 5, 9], [5, 0, 10], [9, 10, 0.0]]), list("ABC"))
    assert newick == "(A:2, C:7, B:3);"
    d = np.array([[0, 3, 7, 8], [3, 0, 8, 9], [7, 8, 0, 9], [8, 9, 9, 0.0]])
    newick, edges = tree.neighbour_joining(d, list("ABCD"))
    assert newick == "(C:4, (A:1, B:2):2, D:5);"
    assert sorted(x for _, _, x in edges) == [1, 2, 2, 4, 5]
    with pytest.raises(ValueError):
        tree.neighbour_joining(d[:2, :2], list("AB"))


def test_tree_recovers_an_additive_distance():
    """Path lengths in the tree equal the distances of a random additive matrix."""
    rng = np.random.default_rng(5)
    n = 9
    parent = {i: int(rng.integers(0, i)) for i in range(1, 2 * n)}
    length = {i: float(rng.uniform(0.5, 2)) for i in parent}

    def path(a):
        out = [(a, 0.0)]
        while a in parent:
            out.append((parent[a], out[-1][1] + length[a]))
            a = parent[a]
        return dict(out)

    tips = [i for i in range(2 * n) if i not in parent.values()][:n]
    d = np.array([[min(path(a)[x] + path(b)[x] for x in path(a) if x in path(b)) for b in tips] for a in tips])
    _, edges = tree.neighbour_joining(d, [str(t) for t in tips])
    near = {}
    for a, b, x in edges:
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))

    def walk(a):
        seen, todo = {a: 0.0}, [a]
        while todo:
            u = todo.pop()
            for v, x in near[u]:
                if v not in seen:
                    seen[v] = seen[u] + x
                    todo.append(v)
        return seen

    for i, a in enumerate(tips):
        for j, b in enumerate(tips):
            assert walk(str(a))[str(b)] == pytest.approx(d[i, j], abs=1e-9)


def test_number_of_components():
    rng = np.random.default_rng(3)
    n, m = 20, 4000
    groups = rng.integers(0, 3, n)
    x = rng.normal(size=(m, 3))[:, groups] + 0.7 * rng.normal(size=(m, n))
    x -= x.mean(1, keepdims=True)
    assert pca.select_k(x.T @ x / m) in (2, 3)


def test_top_k_is_the_svd():
    e = np.random.default_rng(4).normal(size=(50, 8))
    v, s = pca.top_k(e.T @ e, 3)
    _, s2, vt = np.linalg.svd(e, full_matrices=False)
    assert np.allclose(s, s2[:3])
    assert np.allclose(v @ v.T, vt[:3].T @ vt[:3])
    with pytest.raises(ValueError):
        pca.top_k(e.T @ e, 8)


def test_admixture_steps_lower_the_distance():
    rng = np.random.default_rng(8)
    f, q = rng.uniform(0.1, 0.9, (200, 2)), rng.dirichlet((1, 1), 12)
    x = f @ q.T
    f1, q1 = rng.uniform(0.1, 0.9, (200, 2)), rng.dirichlet((1, 1), 12)
    before = np.linalg.norm(x - f1 @ q1.T)
    for _ in range(50):
        f1 = admixture.anc_step(f1, x @ q1, q1.T @ q1)
        q1 = admixture.q_step(q1, x.T @ f1, f1.T @ f1, 0.0)
    assert np.linalg.norm(x - f1 @ q1.T) < 0.2 * before
    assert np.allclose(q1.sum(1), 1.0)


def test_alpha_search_finds_the_peak():
    def fits_of(likelihood, tried):
        def fits(alphas):
            tried.append(alphas)
            return [type("Fit", (), {"log_likelihood": likelihood(a)})() for a in alphas]

        return fits

    tried = []
    best, _ = admixture.alpha_search(fits_of(lambda a: -((a - 3.0) ** 2), tried), 10.0, 7)
    assert abs(best - 3.0) < 0.3 and len(tried) == 7
    # the lower of two values wins if it helps, even where the higher one is better still
    tried = []
    best, _ = admixture.alpha_search(fits_of({0.0: 0, 5.0: 1, 10.0: 0, 2.5: 2, 7.5: 3}.get, tried), 10.0, 2)
    assert tried == [[0.0, 5.0, 10.0], [2.5, 7.5]] and best == 2.5
    tried = []
    best, _ = admixture.alpha_search(fits_of(lambda a: -abs(a - 1.0), tried), 10.0, 6)
    assert tried == [[0.0, 5.0, 10.0], [2.5], [1.25], [0.625], [0.3125], [0.15625]] and best == 1.25
    best, _ = admixture.alpha_search(fits_of(lambda a: -a, []), 10.0, 5)
    assert best == 0.0
    assert math.isfinite(best)
