"""Individual allele frequencies by an iterated low-rank model.

Per round one pass over the sites: project, clamp, expected dosage, and the inner products
of samples. Eigenvectors V of these products give the rank-k product as E V V', which is
local to a site. Up to ``DIRECT`` samples the products are one samples-by-samples matrix on
the driver; beyond, they are only ever multiplied by a few vectors, a pass each.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.passes import (
    TILE,
    Columns,
    checkpointed,
    collect_matrix,
    shared_path,
    site_sums,
    to_arrow,
    with_site_columns,
)
from .covariance import ARRAY, as_pi, covariance, covariance_strips, dosage_pop, gram
from .fixed_point import CUT_EVERY

#: Samples up to which the matrix of products is taken whole: 200 MB.
DIRECT = 5000
#: Vectors beyond those wanted, passes at most, and residual over largest value, of the search in a subspace.
SPARE, MOST_PASSES, RESIDUAL = 8, 40, 1e-10
#: Components that the choice of their number looks at, and the residual that it asks of their vectors.
MOST_COMPONENTS, LOOSE = 15, 1e-7
#: A residual variance below this part of the sample's variance is the error of the vectors, and counts as 0.
NO_VARIANCE = 1e-6
#: Scores that differ by less than this part of the smallest are equal: one component left makes exactly 1, as no variance does.
EQUAL_SCORES = 1e-9


def top_k(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of E from its products, largest first."""
    if not 0 < n < len(g):
        raise ValueError(f"components must be between 1 and {len(g) - 1}")
    values, vectors = np.linalg.eigh(g)
    return vectors[:, ::-1][:, :n], np.sqrt(np.maximum(values[::-1][:n], 0.0))


def lanczos(
    product: Callable[[np.ndarray], np.ndarray], samples: int, n: int, start: np.ndarray | None = None, residual: float = RESIDUAL
) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and values of a symmetric matrix that can only be multiplied by a few vectors.

    Each pass multiplies a block of vectors, which are then made orthogonal to all before, until the wanted
    pairs solve the eigenproblem to ``residual``. Warns if they don't after ``MOST_PASSES``.
    """
    known = np.zeros((samples, 0)) if start is None else start
    random = np.random.default_rng(1).normal(size=(samples, min(n + SPARE, samples) - known.shape[1]))
    q = np.linalg.qr(np.hstack([known, random]))[0]
    basis, images = q, product(q)
    for _ in range(MOST_PASSES):
        values, w = np.linalg.eigh(basis.T @ images)
        values, w = values[::-1][:n], w[:, ::-1][:, :n]
        v = basis @ w
        off = np.linalg.norm(images @ w - v * values, axis=0).max()
        room = samples - basis.shape[1]
        if off <= residual * max(values[0], 0.0) or not room:
            return v, values
        q = images[:, -q.shape[1] :][:, :room]
        for _ in range(3):  # what is left of a block is small, so one projection is not enough
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        basis, images = np.hstack([basis, q]), np.hstack([images, product(q)])
    warnings.warn(f"{n} leading vectors after {MOST_PASSES} passes: residual {off:.1e}", RuntimeWarning, stacklevel=2)
    return v, values


def leading(
    panel: DataFrame, n: int, start: np.ndarray | None = None, direct: int = DIRECT
) -> tuple[np.ndarray, np.ndarray]:
    """``top_k`` of column e of ``panel``, which should be cached; ``start``: vectors near the wanted ones.

    Beyond ``direct`` samples by block Lanczos: driver and tasks hold samples-by-block matrices, never samples by samples.
    """
    first = panel.select(F.size("e")).first()
    samples = first[0] if first else 0
    if samples <= direct:
        return top_k(collect_matrix(gram(panel)), n)
    if not 0 < n < samples:
        raise ValueError(f"components must be between 1 and {samples - 1}")

    def product(q: np.ndarray) -> np.ndarray:
        return collect_matrix(site_sums(panel, lambda c: c["e"].T @ (c["e"] @ q)))

    v, values = lanczos(product, samples, n, start)
    return v, np.sqrt(np.maximum(values, 0.0))


def aligned(v: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``v`` with the signs of its columns turned towards ``before``."""
    return v * np.where((v * before).sum(axis=0) < 0, -1.0, 1.0)


def project(panel: DataFrame, v: np.ndarray) -> DataFrame:
    """proj = e V V'."""
    return with_site_columns(panel, lambda c: {"proj": c["e"] @ v @ v.T}, proj=ARRAY)


def _next(v: np.ndarray):
    def make(c: Columns) -> Columns:
        pi = k.clamp_pi(c["e"] @ v @ v.T, c["f"])
        return {"pi": pi, "e": k.dosage(c["l0"], c["l1"], pi) - 2.0 * c["f"][:, None]}

    return make


@dataclass
class Model:
    """``panel`` has pi; ``cov`` is (i, j, v)."""

    panel: DataFrame
    cov: DataFrame
    components: int
    rounds: int
    converged: bool


def _first_smallest(scores: Sequence[float]) -> int:
    """1 + the place of the first score that is the smallest but for rounding; 1 if there is none."""
    scores = np.asarray(scores)
    return 1 + int(np.argmax(scores <= scores.min() + EQUAL_SCORES * abs(scores.min()))) if len(scores) else 1


def select_k(c: np.ndarray, most: int = MOST_COMPONENTS) -> int:
    """Number of components by the minimum average partial test on a covariance.

    Components are taken out one by one; the average squared partial correlation of what is
    left is smallest after the right number, the least of equal ones (``EQUAL_SCORES``). A step that leaves a sample
    no variance (``NO_VARIANCE``) scores 1.
    """
    n = len(c)
    values, vectors = np.linalg.eigh(c)
    count = min(n - 1, most)
    lead = vectors[:, ::-1][:, :count] * np.sqrt(np.maximum(values[::-1][:count], 0.0))
    scores, rest = [], c.copy()
    for e in range(count):
        rest = rest - np.outer(lead[:, e], lead[:, e])
        d = np.diag(rest)
        if not (d > NO_VARIANCE * np.diag(c)).all():
            scores.append(1.0)
            continue
        r = rest / np.sqrt(np.outer(d, d))
        scores.append(((r**2).sum() - n) / (n * (n - 1)))
    return _first_smallest(scores)


def select_components(strips: DataFrame, samples: int, most: int = MOST_COMPONENTS) -> int:
    """``select_k`` of a covariance that is only ever read in strips (i, j0, v, sites), which should be a table.

    The leading vectors come from products of the strips with a few vectors, and the partial correlations that are left after each
    component are squared and summed strip by strip, all in one pass. Driver and tasks hold ``most`` vectors of samples.
    """
    count = min(samples - 1, most)

    def product(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [
                    v.values.to_numpy() @ q[j : j + len(v)] / n
                    for j, v, n in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)
                ]
                if parts:
                    yield pa.RecordBatch.from_arrays([batch.column(0), to_arrow(np.stack(parts))], ["i", "y"])

        out = np.zeros((samples, q.shape[1]))
        rows = strips.mapInArrow(run, "i int, y array<double>").toPandas()  # samples x tiles in a row, a block of vectors wide
        np.add.at(out, rows["i"].to_numpy(), np.stack(rows["y"]))
        return out

    own = strips.where("i >= j0 AND i < j0 + size(v)").selectExpr("i", "v[i - j0] / sites AS d").toPandas()
    diagonal = np.zeros(samples)
    diagonal[own["i"]] = own["d"]
    vectors, values = lanczos(product, samples, count, residual=LOOSE)
    lead = vectors * np.sqrt(np.maximum(values, 0.0))
    left = diagonal[:, None] - np.cumsum(lead**2, axis=1)  # diagonals after each component
    usable = (left > NO_VARIANCE * diagonal[:, None]).all(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.where(usable, 1.0 / left, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(count)
        for batch in batches:
            for i, j, v, n in zip(*(c if k == 2 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                at = slice(j, j + len(v))
                rest = v.values.to_numpy()[:, None] / n - np.cumsum(lead[i] * lead[at], axis=1)
                sums += (rest**2 * inverse[at]).sum(axis=0) * inverse[i]
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(sums)], ["e", "s"])

    rows = strips.mapInArrow(run, "e int, s double").groupBy("e").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(count)
    for e, x in rows:
        sums[e] = x
    scores = np.where(usable, (sums - samples) / (samples * (samples - 1)), 1.0)
    return _first_smallest(scores)


def choose_components(panel: DataFrame, direct: int = DIRECT, tile: int = TILE) -> int:
    """Number of components of a panel with f: on the whole covariance up to ``direct`` samples, in strips beyond."""
    first = panel.select(F.size("l0")).first()
    samples = first[0] if first else 0
    if samples <= direct:
        return select_k(collect_matrix(covariance(panel)))
    strips, path = covariance_strips(panel, tile=tile), shared_path(panel.sparkSession, "covariance")
    strips.write.parquet(path)
    return select_components(panel.sparkSession.read.schema(strips.schema).parquet(path), samples)


def fit_pi(
    panel: DataFrame,
    components: int = 0,
    tol: float = 1e-5,
    most_rounds: int = 100,
    fixed_rounds: int | None = None,
) -> Model:
    """Individual frequencies of a panel with f; 0 components: chosen by ``choose_components``.

    ``most_rounds`` of 0 is the population model: pi is f and the covariance that of f.
    """
    components = components or choose_components(panel)
    rounds_left = most_rounds if fixed_rounds is None else fixed_rounds
    if not rounds_left:
        return Model(as_pi(panel), covariance(panel), components, 0, False)
    now = dosage_pop(panel).persist(StorageLevel.MEMORY_AND_DISK)
    v, _ = leading(now, components)
    rounds, done = 0, False
    while rounds < rounds_left and not done:
        rounds += 1
        then = with_site_columns(now, _next(v), pi=ARRAY, e=ARRAY)
        if rounds % CUT_EVERY == 0:
            then = checkpointed(then)
        then = then.persist(StorageLevel.MEMORY_AND_DISK)
        found, _ = leading(then, components, v)
        found = aligned(found, v)
        done = fixed_rounds is None and float(np.sqrt(((found - v) ** 2).mean())) < tol
        v = found
        now.unpersist()
        now = then
    final = with_site_columns(
        now.drop("pi"), lambda c: {"pi": k.clamp_pi(c["e"] @ v @ v.T, c["f"])}, pi=ARRAY
    ).drop("e")
    return Model(final, covariance(final, "pi"), components, rounds, done)
