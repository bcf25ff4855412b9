"""Tail of the chi-square distribution for whole degrees of freedom, in closed form."""

from __future__ import annotations

import math

import numpy as np

#: Terms of the series, below FAR, and of the continued fraction, from there on; the error is below 1e-14.
TERMS, FAR = 80, 2.5


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers that aren't negative, all at once."""
    near, far = np.minimum(x, FAR), np.maximum(x, FAR)
    term = near.copy()
    total = term.copy()
    for n in range(1, TERMS):  # erf x = 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (1 3 5 ... (2n+1))
        term = term * (2.0 * near * near / (2 * n + 1))
        total += term
    below = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-near * near) * total
    fraction = far.copy()
    for n in range(TERMS, 0, -1):  # sqrt(pi) exp(x^2) erfc x = 1 / (x + (1/2) / (x + 1 / (x + (3/2) / (x + ...
        fraction = far + (n / 2.0) / fraction
    beyond = np.exp(-far * far) / (math.sqrt(math.pi) * fraction)
    return np.where(x < FAR, below, beyond)


def chi2_upper(x: np.ndarray, degrees: int) -> np.ndarray:
    """P(X > x). Even: a Poisson sum; odd: erfc and the matching sum over half-integers."""
    h = np.maximum(np.asarray(x, float), 0.0) / 2.0
    if degrees % 2 == 0:
        term = np.exp(-h)
        total = term.copy()
        for i in range(1, degrees // 2):
            term = term * h / i
            total += term
        return total
    total = _erfc(np.sqrt(h))
    term = np.exp(-h) * np.sqrt(h) / math.gamma(1.5)
    for i in range(1, (degrees - 1) // 2 + 1):
        total = total + term
        term = term * h / (i + 0.5)
    return total
