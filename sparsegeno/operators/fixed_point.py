"""Accelerated fixed-point iteration with the state in a column of the panel.

A round takes two steps x1 = g(x), x2 = g(x1), extrapolates by one global factor
c = clamp(-sum(u^2) / sum(uv), 1, 256) with u = x1 - x, v = x2 - x1 - u, to
(1 - c) x1 + c x2, and steps once more from there. The last step of a round and the first
two of the next are one pass, so a round is one job and its sums one row on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passes import Columns, checkpointed, with_site_columns

Step = Callable[[Columns, np.ndarray], np.ndarray]
#: Rounds between cuts of the lineage.
CUT_EVERY = 5
LARGEST = 256.0


@dataclass
class Fit:
    panel: DataFrame
    rounds: int
    converged: bool
    held: DataFrame | None = None

    def release(self) -> None:
        """Frees the cached state; ``panel`` is worked out anew if it is read after that."""
        if self.held is not None:
            self.held.unpersist()


def factor(uu: float, uv: float) -> float:
    """The extrapolation factor; 1 (a plain step) where it is undefined."""
    if not uv:
        return 1.0
    return min(max(-uu / uv, 1.0), LARGEST)


def jump(x1: np.ndarray, x2: np.ndarray, c: float, low: float, high: float) -> np.ndarray:
    return np.clip((1.0 - c) * x1 + c * x2, low, high)


def solve(
    panel: DataFrame,
    state: str,
    step: Step,
    low: float,
    high: float,
    tol: float,
    most_rounds: int,
    shortcut: bool = False,
    fixed_rounds: int | None = None,
) -> Fit:
    """``panel`` with column ``state`` iterated until the RMS change of a round is below ``tol``.

    ``shortcut``: if the first two steps change nothing, their result is final (hard calls).
    ``fixed_rounds`` runs exactly that many rounds instead.
    """
    before, one, two = f"__{state}0", f"__{state}1", f"__{state}2"
    new = {before: "double", state: "double", one: "double", two: "double"}
    others = [c for c in panel.columns if c != state]

    def first(cols: Columns) -> Columns:
        x = cols[state]
        x1 = step(cols, x)
        return {before: x, state: x, one: x1, two: step(cols, x1)}

    def later(c: float) -> Callable[[Columns], Columns]:
        def advance(cols: Columns) -> Columns:
            x = step(cols, jump(cols[one], cols[two], c, low, high))
            x1 = step(cols, x)
            return {before: cols[state], state: x, one: x1, two: step(cols, x1)}

        return advance

    u = F.col(one) - F.col(state)
    v = F.col(two) - F.col(one) - u
    far = [F.max(F.abs(F.col(b) - F.col(a)) - (1e-8 + 1e-5 * F.abs(F.col(b)))) for a, b in ((state, one), (one, two))]
    sums = (
        F.sum(u * u).alias("uu"),
        F.sum(u * v).alias("uv"),
        F.avg(F.pow(F.col(state) - F.col(before), 2)).alias("change"),
        far[0].alias("far1"),
        far[1].alias("far2"),
    )
    limit = most_rounds if fixed_rounds is None else fixed_rounds
    now = with_site_columns(panel, first, **new).persist(StorageLevel.MEMORY_AND_DISK)
    s = now.agg(*sums).first()
    if s["uu"] is None:  # no sites
        return Fit(now.select(*others, state), 0, True)
    if shortcut and fixed_rounds is None and (s["far1"] <= 0 or s["far2"] <= 0):
        return Fit(now.select(*others, F.col(two).alias(state)), 1, True, now)
    done, rounds = False, 0
    while rounds < limit and not done:
        rounds += 1
        then = with_site_columns(now, later(factor(s["uu"], s["uv"])), **new)
        if rounds % CUT_EVERY == 0:
            then = checkpointed(then)
        then = then.persist(StorageLevel.MEMORY_AND_DISK)
        s = then.agg(*sums).first()
        now.unpersist()
        now = then
        done = fixed_rounds is None and s["change"] ** 0.5 < tol
    return Fit(now.select(*others, state), rounds, done, now)
