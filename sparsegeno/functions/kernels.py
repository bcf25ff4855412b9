"""Formulas on (likelihoods, frequency), on whole matrices of sites by samples.

With likelihoods L0, L1, L2 = 1 - L0 - L1 and frequency p a genotype g has the weight
L_g * C(2, g) p^g (1 - p)^(2 - g); posteriors are normalised weights, the dosage is the
posterior mean.
"""

from __future__ import annotations

import numpy as np

Array = np.ndarray

MIN_PI = 1e-4
MIN_F = 1e-5
MIN_PRIOR = 1e-4
MIN_POSTERIOR = 1e-10
MISSING = -9


def weights(l0: Array, l1: Array, p: Array) -> tuple[Array, Array, Array]:
    q = 1.0 - p
    return l0 * q * q, 2.0 * l1 * p * q, (1.0 - l0 - l1) * p * p


def _share(part: Array, whole: Array) -> Array:
    """part / whole, 0 where whole is 0 (likelihoods that rule everything out)."""
    return np.divide(part, whole, out=np.zeros(np.broadcast(part, whole).shape), where=whole != 0)


def dosage(l0: Array, l1: Array, p: Array) -> Array:
    w0, w1, w2 = weights(l0, l1, p)
    return _share(w1 + 2.0 * w2, w0 + w1 + w2)


def em_step(l0: Array, l1: Array, f: Array) -> Array:
    """One allele-frequency EM step per site: half the mean dosage."""
    return dosage(l0, l1, f[:, None]).mean(axis=1) / 2.0


def clamp_pi(proj: Array, f: Array) -> Array:
    """Individual frequencies from a centred low-rank product."""
    return np.clip((proj + 2.0 * f[:, None]) / 2.0, MIN_PI, 1.0 - MIN_PI)


def scale(f: Array) -> Array:
    """Standard deviation of a genotype under Hardy-Weinberg, as a column; f must not be 0 or 1."""
    return np.sqrt(2.0 * f * (1.0 - f))[:, None]


def standardised(l0: Array, l1: Array, p: Array, f: Array) -> Array:
    return (dosage(l0, l1, p) - 2.0 * f[:, None]) / scale(f)


def spread(l0: Array, l1: Array, p: Array, f: Array) -> Array:
    """Posterior mean of (g - 2f)^2 / (2f(1 - f)), the diagonal's summand."""
    w0, w1, w2 = weights(l0, l1, p)
    m = 2.0 * f[:, None]
    sq = m * m * w0 + (1.0 - m) ** 2 * w1 + (2.0 - m) ** 2 * w2
    return _share(sq, w0 + w1 + w2) / scale(f) ** 2


def posterior(l0: Array, l1: Array, p: Array) -> tuple[Array, Array, Array]:
    w = weights(l0, l1, p)
    total = w[0] + w[1] + w[2]
    return tuple(np.maximum(_share(x, total), MIN_POSTERIOR) for x in w)


def inbred_weights(l0: Array, l1: Array, p: Array, f_in: Array, strict: bool = False) -> tuple[Array, Array, Array]:
    """Weights with inbreeding: homozygotes gain p(1 - p)F; ``strict`` takes it from heterozygotes."""
    q = 1.0 - p
    more = p * q * f_in
    het = 2.0 * p * q * (1.0 - f_in) if strict else 2.0 * p * q
    return l0 * (q * q + more), l1 * het, (1.0 - l0 - l1) * (p * p + more)


def posterior_inbred(l0, l1, p, f_in, strict: bool = False) -> tuple[Array, Array, Array]:
    w = inbred_weights(l0, l1, p, f_in, strict)
    total = w[0] + w[1] + w[2]
    return tuple(np.maximum(_share(x, total), MIN_POSTERIOR) for x in w)


def call(w: tuple[Array, Array, Array], delta: float) -> Array:
    """The most likely genotype, -9 unless its posterior exceeds delta.

    Ties go to the larger copy number: (0, 1) to 1, (0, 2) and (1, 2) to 2.
    """
    w0, w1, w2 = w
    g = np.where((w0 > w1) & (w0 > w2), 0, np.where(w1 > w2, 1, 2)).astype(np.int8)
    best = np.choose(g, [w0, w1, w2])
    return np.where(_share(best, w0 + w1 + w2) > delta, g, np.int8(MISSING)).astype(np.int8)


def inbred_prior(p: Array, f_in: Array) -> tuple[Array, Array, Array]:
    q = 1.0 - p
    more = p * q * f_in
    a = np.maximum(MIN_PRIOR, q * q + more)
    b = np.maximum(MIN_PRIOR, 2.0 * p * q * (1.0 - f_in))
    c = np.maximum(MIN_PRIOR, p * p + more)
    total = a + b + c
    return a / total, b / total, c / total


def heterozygosity(l0: Array, l1: Array, p: Array, f_in: Array) -> tuple[Array, Array]:
    """Observed (posterior) and expected heterozygosity of each cell."""
    a, b, c = inbred_prior(p, f_in)
    w0, w1, w2 = l0 * a, l1 * b, (1.0 - l0 - l1) * c
    return _share(w1, w0 + w1 + w2), 2.0 * p * (1.0 - p)


def inbreeding(observed: Array, expected: Array) -> Array:
    return np.clip(1.0 - _share(observed, expected), -1.0, 1.0)


def likelihood_ratio(l0: Array, l1: Array, p: Array, f_in: Array) -> Array:
    """Twice the log-likelihood gain of inbreeding over Hardy-Weinberg, per site."""
    a, b, c = inbred_prior(p, f_in)
    l2 = 1.0 - l0 - l1
    with_f = np.log(l0 * a + l1 * b + l2 * c).sum(axis=1)
    w0, w1, w2 = weights(l0, l1, p)
    return 2.0 * (with_f - np.log(w0 + w1 + w2).sum(axis=1))
