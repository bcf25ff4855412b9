"""Genotype posteriors and calls, narrow passes over a panel with pi."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import kernels as k
from ..functions.passes import Columns, with_site_columns
from .covariance import ARRAY


def posteriors(panel: DataFrame, inbreed: np.ndarray | None = None, strict_prior: bool = False) -> DataFrame:
    """Arrays p0, p1, p2, floored at 1e-10; with inbreeding per sample if given."""

    def make(c: Columns) -> Columns:
        if inbreed is None:
            p = k.posterior(c["l0"], c["l1"], c["pi"])
        else:
            p = k.posterior_inbred(c["l0"], c["l1"], c["pi"], inbreed[None, :], strict_prior)
        return dict(zip(("p0", "p1", "p2"), p, strict=True))

    return with_site_columns(panel, make, p0=ARRAY, p1=ARRAY, p2=ARRAY)


def calls(panel: DataFrame, delta: float = 0.0, inbreed: np.ndarray | None = None, strict_prior: bool = False) -> DataFrame:
    """Array ``call``: 0, 1, 2, or -9 where no posterior exceeds ``delta``."""

    def make(c: Columns) -> Columns:
        if inbreed is None:
            w = k.weights(c["l0"], c["l1"], c["pi"])
        else:
            w = k.inbred_weights(c["l0"], c["l1"], c["pi"], inbreed[None, :], strict_prior)
        return {"call": k.call(w, delta)}

    return with_site_columns(panel, make, call="array<tinyint>")
