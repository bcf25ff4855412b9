"""Selection scans: one factorisation of the sample products feeds all three statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passes import Columns, to_numpy, with_site_columns
from ..functions.statistics import chi2_upper
from .covariance import ARRAY, dosage_std
from .pca import leading


def scans(panel: DataFrame, components: int) -> DataFrame:
    """``panel`` (f, pi) with ``selection``, ``pcadapt`` and ``weight`` per component.

    With singular vectors V and values s of the standardised dosages e over M sites and N
    samples: selection = M (eV / s)^2, weight = (eV) s / M, and pcadapt is eV over the
    residual's standard deviation with N - K degrees of freedom (0 without a residual).
    """
    rows = dosage_std(panel).persist(StorageLevel.MEMORY_AND_DISK)  # read for the count, the products, the scores
    sites = rows.count()
    if not sites:
        return rows.drop("e").selectExpr("*", *(f"cast(null as {ARRAY}) as {c}" for c in ("selection", "pcadapt", "weight")))
    v, s = leading(rows, components)

    def make(c: Columns) -> Columns:
        e = c["e"]
        b = e @ v
        total = (e**2).sum(axis=1)
        rest = total - (b**2).sum(axis=1)
        rest = np.where(rest > 1e-12 * total, rest, 0.0)  # what cancellation leaves is no residual
        sd = np.sqrt(rest / (e.shape[1] - components))[:, None]
        z = np.divide(b, sd, out=np.zeros_like(b), where=sd > 0)
        return {"selection": sites * (b / s) ** 2, "pcadapt": z, "weight": b * s / sites}

    return with_site_columns(rows, make, selection=ARRAY, pcadapt=ARRAY, weight=ARRAY).drop("e")


#: Bits of a number that one pass over the sites settles.
BITS = 13
Make = Callable[[np.ndarray], np.ndarray]


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)  # no negative zero
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _numbers(keys: np.ndarray) -> np.ndarray:
    bits = np.where(keys >> np.uint64(63), keys & np.uint64(2**63 - 1), ~keys)
    return np.ascontiguousarray(bits).view(np.float64)


def medians(rows: DataFrame, column: str, make: Make) -> np.ndarray:
    """The exact medians of all columns that ``make`` gives for an array column, taken together.

    Numbers are settled from their first bits on: each pass counts, for all columns at once, how the sites that agree with the
    bits so far go on, so the passes depend on the size of a number alone, not on sites or columns. The two
    middle values of an even number are followed side by side. ``rows`` should be cached and have no nulls.
    """
    values, below, total, left = None, None, None, 64
    while left:
        taken, left = left, max(0, left - BITS)
        known = values

        def run(batches: Iterator[pa.RecordBatch], known=known, taken=taken, left=left) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = _keys(make(to_numpy(batch.column(0))))
                for c in range(keys.shape[1]):
                    for side in (0,) if known is None or known[c, 0] == known[c, 1] else (0, 1):
                        k = keys[:, c] if known is None else keys[keys[:, c] >> np.uint64(taken) == known[c, side], c]
                        bins = (k >> np.uint64(left)) & np.uint64((1 << (taken - left)) - 1)
                        found = np.bincount(bins.astype(np.int64), minlength=1 << (taken - left))
                        counts[c, side] = counts[c, side] + found if (c, side) in counts else found
            for (c, side), n in counts.items():
                at = np.flatnonzero(n)
                same = [np.full(len(at), x, np.int32) for x in (c, side)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, at, n[at])], ["c", "side", "bin", "n"])

        counted = rows.select(column).mapInArrow(run, "c int, side int, bin long, n long")
        table = counted.groupBy("c", "side", "bin").agg(F.sum("n").alias("n")).toPandas()
        if values is None:
            columns = 1 + int(table["c"].max())
            total = int(table.loc[table["c"] == 0, "n"].sum())
            values, below = np.zeros((columns, 2), np.uint64), np.zeros((columns, 2), np.int64)
        alike = values[:, 0] == values[:, 1]
        for c in range(len(values)):
            for side, rank in enumerate(((total - 1) // 2, total // 2)):
                mine = table[(table["c"] == c) & (table["side"] == (0 if alike[c] else side))].sort_values("bin")
                ends = below[c, side] + mine["n"].cumsum().to_numpy()
                at = int(np.searchsorted(ends, rank, side="right"))
                below[c, side] = ends[at] - mine["n"].iloc[at]
                values[c, side] = (int(values[c, side]) << (taken - left)) | int(mine["bin"].iloc[at])
    return _numbers(values).mean(axis=1)


def _robust(rows: DataFrame, column: str, make: Make) -> tuple[np.ndarray, np.ndarray]:
    """Medians and scaled median deviations of all columns of ``make``; a deviation of 0 counts as 1."""
    mids = medians(rows, column, make)
    off = 1.4826022185056018 * medians(rows, column, lambda z: np.abs(make(z) - mids))
    return mids, np.where(off > 0, off, 1.0)


def distances(rows: DataFrame, z: str = "pcadapt", components: int = 1) -> DataFrame:
    """``rows`` with d2, the robust squared distance of the z-scores from their centre.

    One component: (z - median)^2. More: orthogonalised pairwise estimation (Maronna and
    Zamar 2002): scales of sums and differences of columns give a covariance, its
    eigenvectors give new axes, and the distance is measured by median and deviation on these.
    ``rows`` should be cached; it is read several times, as often for many components as for two.
    """
    if not rows.count():
        return rows.withColumn("d2", F.lit(None).cast("double"))
    if components == 1:
        (mid,) = medians(rows, z, lambda x: x[:, :1])
        return rows.withColumn("d2", F.pow(F.get(z, 0) - F.lit(float(mid)), 2))
    _, scales = _robust(rows, z, lambda x: x[:, :components])
    i, j = np.tril_indices(components, -1)

    def pairs(x: np.ndarray) -> np.ndarray:
        y = x[:, :components] / scales
        return np.hstack([y[:, i] + y[:, j], y[:, i] - y[:, j]])

    _, spread = _robust(rows, z, pairs)
    u = np.eye(components)
    u[i, j] = u[j, i] = (spread[: len(i)] ** 2 - spread[len(i) :] ** 2) / 4.0
    axes = np.linalg.eigh(u)[1] / scales[:, None]  # from z-scores to the new axes
    mids, widths = _robust(rows, z, lambda x: x[:, :components] @ axes)

    def off(a: int) -> Column:
        on = sum((F.get(z, k) * float(axes[k, a]) for k in range(components)), F.lit(0.0))
        return F.pow((on - float(mids[a])) / float(widths[a]), 2)

    return rows.withColumn("d2", sum((off(a) for a in range(components)), F.lit(0.0)))


def p_values(rows: DataFrame, statistic: str, degrees: int, name: str = "p") -> DataFrame:
    """``rows`` with the upper tail of chi-square at ``statistic``."""
    if degrees < 1 or not math.isfinite(degrees):
        raise ValueError("degrees of freedom must be positive")
    kept = rows.withColumn(statistic, F.col(statistic).cast("double"))
    return with_site_columns(kept, lambda c: {name: chi2_upper(c[statistic], degrees)}, **{name: "double"})
