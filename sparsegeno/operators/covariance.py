"""Expected dosages and sample covariance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.passes import TILE, Columns, strip_cells, tile_sums, with_site_columns

ARRAY = "array<double>"


def as_pi(panel: DataFrame) -> DataFrame:
    """``panel`` with pi = f for every sample: the population model."""
    return panel.withColumn("pi", F.transform("l0", lambda _: F.col("f")))


def dosage_pop(panel: DataFrame) -> DataFrame:
    """e = d(f) - 2f."""
    return with_site_columns(
        panel, lambda c: {"e": k.dosage(c["l0"], c["l1"], c["f"][:, None]) - 2.0 * c["f"][:, None]}, e=ARRAY
    )


def dosage_ind(panel: DataFrame) -> DataFrame:
    """From the centred product ``proj``: pi, clamped, and e = d(pi) - 2f."""

    def make(c: Columns) -> Columns:
        pi = k.clamp_pi(c["proj"], c["f"])
        return {"pi": pi, "e": k.dosage(c["l0"], c["l1"], pi) - 2.0 * c["f"][:, None]}

    return with_site_columns(panel, make, pi=ARRAY, e=ARRAY)


def dosage_std(panel: DataFrame) -> DataFrame:
    """e = (d(pi) - 2f) / sqrt(2f(1 - f))."""
    return with_site_columns(panel, lambda c: {"e": k.standardised(c["l0"], c["l1"], c["pi"], c["f"])}, e=ARRAY)


def dosage_out(panel: DataFrame) -> DataFrame:
    """e = d(pi)."""
    return with_site_columns(panel, lambda c: {"e": k.dosage(c["l0"], c["l1"], c["pi"])}, e=ARRAY)


def gram(panel: DataFrame, column: str = "e", mean: bool = False, tile: int = TILE) -> DataFrame:
    """(i, j, v): inner products of samples over all sites, or their mean per site."""
    return strip_cells(tile_sums(panel, lambda c: (c[column], None), tile), mean)


def covariance_strips(panel: DataFrame, pi: str | None = None, tile: int = TILE) -> DataFrame:
    """The sums behind ``covariance`` as strips of rows."""

    def make(c: Columns) -> tuple[np.ndarray, np.ndarray]:
        p = c[pi] if pi else c["f"][:, None]
        e = k.standardised(c["l0"], c["l1"], p, c["f"])
        return e, k.spread(c["l0"], c["l1"], p, c["f"]).sum(axis=0)

    return tile_sums(panel, make, tile)


def covariance(panel: DataFrame, pi: str | None = None, tile: int = TILE) -> DataFrame:
    """(i, j, v): covariance of standardised dosages under f, or under individual frequencies ``pi``.

    The diagonal is the mean posterior variance instead of the product.
    """
    return strip_cells(covariance_strips(panel, pi, tile), mean=True)


def pi_standardised(panel: DataFrame) -> DataFrame:
    """z = (pi - f) / sqrt(f(1 - f))."""

    def make(c: Columns) -> Columns:
        f = c["f"][:, None]
        return {"z": (c["pi"] - f) / np.sqrt(f * (1.0 - f))}

    return with_site_columns(panel, make, z=ARRAY)


def pi_covariance(panel: DataFrame, tile: int = TILE) -> DataFrame:
    """(i, j, v): mean product of standardised individual frequencies."""
    return gram(pi_standardised(panel), "z", mean=True, tile=tile)
