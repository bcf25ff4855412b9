"""Inbreeding per site and per sample, and the test for Hardy-Weinberg proportions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import kernels as k
from ..functions.passes import Columns, collect_matrix, site_sums, with_site_columns
from .fixed_point import Fit, factor, jump, solve


def _site_step(c: Columns, x: np.ndarray) -> np.ndarray:
    seen, expected = k.heterozygosity(c["l0"], c["l1"], c["pi"], x[:, None])
    return k.inbreeding(seen.sum(axis=1), expected.sum(axis=1))


def sites_step(panel: DataFrame, steps: int = 1) -> DataFrame:
    """Column ``inbreed`` after plain steps from 0."""

    def make(c: Columns) -> Columns:
        x = np.zeros(len(c["l0"]))
        for _ in range(steps):
            x = _site_step(c, x)
        return {"inbreed": x}

    return with_site_columns(panel, make, inbreed="double")


def per_site(panel: DataFrame, tol: float = 1e-5, most_rounds: int = 500, fixed_rounds: int | None = None) -> Fit:
    """Accelerated fit of ``inbreed`` for every site of a panel with pi."""
    return solve(sites_step(panel), "inbreed", _site_step, -1.0, 1.0, tol, most_rounds, fixed_rounds=fixed_rounds)


def likelihood_ratios(panel: DataFrame) -> DataFrame:
    """``lrt``: twice the gain in log-likelihood of ``inbreed`` over Hardy-Weinberg proportions."""
    return with_site_columns(
        panel,
        lambda c: {"lrt": k.likelihood_ratio(c["l0"], c["l1"], c["pi"], c["inbreed"][:, None])},
        lrt="double",
    )


def samples_step(panel: DataFrame, x: np.ndarray) -> np.ndarray:
    """One step for all samples: two sums per sample over all sites."""

    def make(c: Columns) -> np.ndarray:
        seen, expected = k.heterozygosity(c["l0"], c["l1"], c["pi"], x[None, :])
        return np.stack([seen.sum(axis=0), expected.sum(axis=0)])

    seen, expected = collect_matrix(site_sums(panel, make))
    return k.inbreeding(seen, expected)


def per_sample(
    panel: DataFrame,
    samples: int,
    tol: float = 1e-5,
    most_rounds: int = 500,
    fixed_rounds: int | None = None,
) -> tuple[np.ndarray, int, bool]:
    """Accelerated fit for every sample; the state is one number per sample, on the driver."""
    limit = most_rounds if fixed_rounds is None else fixed_rounds
    x = samples_step(panel, np.zeros(samples))
    rounds, done = 0, False
    while rounds < limit and not done:
        rounds += 1
        x1 = samples_step(panel, x)
        x2 = samples_step(panel, x1)
        u = x1 - x
        v = x2 - x1 - u
        new = samples_step(panel, jump(x1, x2, factor(float(u @ u), float(u @ v)), -1.0, 1.0))
        done = fixed_rounds is None and float(np.sqrt(((new - x) ** 2).mean())) < tol
        x = new
    return x, rounds, done
