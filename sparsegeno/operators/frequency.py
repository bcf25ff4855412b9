"""Population allele frequencies and the filters on them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.passes import with_site_columns
from .fixed_point import Fit, solve

START = 0.25


def em_step(panel: DataFrame, f: str = "f") -> DataFrame:
    """``panel`` with ``f`` after one EM step: half the mean dosage of the site."""
    return with_site_columns(panel, lambda c: {f: k.em_step(c["l0"], c["l1"], c[f])}, **{f: "double"})


def em_steps(panel: DataFrame, steps: int) -> DataFrame:
    """Plain EM from START, all steps in one pass."""

    def run(c):
        f = k.em_step(c["l0"], c["l1"], c["l0"][:, 0] * 0 + START)
        for _ in range(steps - 1):
            f = k.em_step(c["l0"], c["l1"], f)
        return {"f": f}

    return with_site_columns(panel, run, f="double")


def allele_frequencies(panel: DataFrame, tol: float = 1e-6, most_rounds: int = 500, fixed_rounds: int | None = None) -> Fit:
    """``panel`` with its maximum-likelihood frequencies ``f`` by accelerated EM.

    The last EM step isn't clamped, so f can come close to 0 or 1.
    """
    return solve(
        em_steps(panel, 1),
        "f",
        lambda c, f: k.em_step(c["l0"], c["l1"], f),
        k.MIN_F,
        1.0 - k.MIN_F,
        tol,
        most_rounds,
        shortcut=True,
        fixed_rounds=fixed_rounds,
    )


def filter_maf(panel: DataFrame, maf: float = 0.05) -> DataFrame:
    """Sites with maf <= f <= 1 - maf; 0 keeps all but f of exactly 0 or 1, which cannot be scaled."""
    if maf == 0:
        return panel.where("f > 0 and f < 1")
    return panel.where(F.col("f").between(maf, 1.0 - maf))


def hwe_bound(tol: float = 1e-6) -> float:
    """Upper quantile of chi-square with one degree of freedom."""
    return NormalDist().inv_cdf(1.0 - tol / 2.0) ** 2


def filter_hwe(panel: DataFrame, tol: float = 1e-6, lrt: str = "lrt") -> DataFrame:
    """Sites whose likelihood ratio is below the bound; NaN goes."""
    return panel.where((F.col(lrt) < hwe_bound(tol)) & ~F.isnan(lrt))


def sites_kept(all_sites: DataFrame, kept: DataFrame) -> DataFrame:
    """(site_idx, keep): 1 for the original sites that are still there."""
    there = kept.select("site_idx", F.lit(1).alias("keep"))
    return all_sites.select("site_idx").join(there, "site_idx", "left").select(
        "site_idx", F.coalesce("keep", F.lit(0)).alias("keep")
    )
