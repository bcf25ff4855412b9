"""Admixture: individual frequencies as a non-negative product of ancestral frequencies and proportions.

Ancestral frequencies (``anc``, k per site) belong to sites, the proportions Q (samples by k) to all tasks.
Sites are dealt to batches by a hash; batch by batch ``anc`` and then Q take multiplicative
steps, and the steps of both stop on norms over the whole batch. Sites stay in the tasks of a barrier stage
for many rounds: each task steps its own sites, and norms and what Q needs are summed over tasks, mostly at once, so
that a round needs no job. Fits with different regularisations run side by side over the same sites, which are dealt to tasks
once for all of them.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import Sums, slots
from ..functions.passes import Columns, collect_matrix, shared_path, site_sums, to_arrow, to_numpy, with_site_columns
from .covariance import ARRAY

LOW = 1e-4
#: Steps of ``anc`` whose norms are summed over tasks at once, when nothing is known from the round before.
TRIED = 8
#: The state is written after so many rounds, or a multiple once so many seconds have passed: a lost executor costs no more.
ROUNDS_PER_STAGE, SECONDS_PER_STAGE = 50, 120


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, LOW, 1.0 - LOW)


def anc_step(anc: np.ndarray, a: np.ndarray, qq: np.ndarray) -> np.ndarray:
    """anc * A / (anc Q'Q) with A = X Q."""
    return _clamp(anc * a / (anc @ qq))


def q_step(q: np.ndarray, xf: np.ndarray, ff: np.ndarray, alpha: float) -> np.ndarray:
    """Q * (X'F) / (Q F'F + alpha), rows summing to 1."""
    new = _clamp(q * xf / (q @ ff + alpha))
    return new / new.sum(axis=1, keepdims=True)


def update_anc(panel: DataFrame, q: np.ndarray, steps: int = 1) -> DataFrame:
    """``panel`` (pi, anc) after that many steps of ``anc`` under Q."""
    qq = q.T @ q

    def make(c: Columns) -> Columns:
        a, anc = c["pi"] @ q, c["anc"]
        for _ in range(steps):
            anc = anc_step(anc, a, qq)
        return {"anc": anc}

    return with_site_columns(panel, make, anc=ARRAY)


def q_sums(panel: DataFrame, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """X'F (samples by k) and F'F (k by k), summed over sites in one job."""
    both = collect_matrix(site_sums(panel, lambda c: np.vstack([c["pi"].T @ c["anc"], c["anc"].T @ c["anc"]])))
    return both[:samples], both[samples:]


def update_q(panel: DataFrame, q: np.ndarray, alpha: float = 0.0, steps: int = 1) -> np.ndarray:
    xf, ff = q_sums(panel, len(q))
    for _ in range(steps):
        q = q_step(q, xf, ff, alpha)
    return q


def log_likelihood(panel: DataFrame, q: np.ndarray) -> float:
    """Sum of log(L0(1-x)^2 + 2 L1 x(1-x) + L2 x^2) with x = anc Q'."""

    def make(c: Columns) -> np.ndarray:
        x = c["anc"] @ q.T
        l0, l1 = c["l0"], c["l1"]
        return np.log(l0 * (1 - x) ** 2 + 2 * l1 * x * (1 - x) + (1 - l0 - l1) * x**2).sum()

    return float(collect_matrix(site_sums(panel, make)).sum())


def frobenius(panel: DataFrame, q: np.ndarray) -> float:
    """Distance of anc Q' from pi."""
    return float(np.sqrt(collect_matrix(site_sums(panel, lambda c: ((c["anc"] @ q.T - c["pi"]) ** 2).sum())).sum()))


def _uniform(site: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on (seed, site, component) alone, so lost tasks redraw the same."""
    x = site.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, k + 1, dtype=np.uint64)
    x += np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def initial(panel: DataFrame, samples: int, k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """``anc`` drawn per site, Q drawn on the driver with rows summing to 1."""
    q = np.random.default_rng(seed).random((samples, k))
    drawn = with_site_columns(panel, lambda c: {"anc": _clamp(_uniform(c["site_idx"], k, seed))}, anc=ARRAY)
    return drawn, q / q.sum(axis=1, keepdims=True)


@dataclass
class Admixture:
    """Q, the panel with ``anc``, and how well they fit."""

    q: np.ndarray
    panel: DataFrame
    log_likelihood: float
    frobenius: float
    rounds: int
    converged: bool


class _Fit:
    """One regularisation's state in one task: Q, and by batch ``anc`` of the task's sites (components by sites) and the steps it took last."""

    def __init__(self, alpha: float, q: np.ndarray, anc: list[np.ndarray], rounds: int, done: bool):
        self.alpha, self.q, self.anc, self.rounds, self.done = alpha, q, anc, rounds, done
        self.steps = [TRIED] * len(anc)


class _Room:
    """Arrays that are used again: fresh ones of some 100 KB would cost more than what is worked out in them."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, name, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size].reshape(shape)


def _tried(anc: np.ndarray, a: np.ndarray, gram: np.ndarray, n: int, room: _Room, fit: int) -> tuple[list[np.ndarray], np.ndarray]:
    """n steps of ``anc`` (components by sites), and the square norm of each."""
    steps, norms, below = [], np.zeros(n), room("below", *anc.shape)
    for t in range(n):
        new = np.multiply(anc, a, out=room((fit, t), *anc.shape))
        new /= np.matmul(gram, anc, out=below)
        np.maximum(new, LOW, out=new)
        np.minimum(new, 1.0 - LOW, out=new)
        far = np.subtract(new, anc, out=below).ravel()
        norms[t] = far @ far
        anc = new
        steps.append(new)
    return steps, norms


def _anc_steps(fits: list[_Fit], b: int, x: np.ndarray, most: int, sums: Sums, room: _Room) -> list[tuple[np.ndarray, np.ndarray]]:
    """Steps of ``anc`` of batch b until one is at most a tenth of the first; F'X and F'F over all tasks for each fit.

    As many steps are tried as the fit took in the round before, and one more. With their norms goes what Q needs if it takes
    as many again, so that one sum is enough when it does.
    """
    grams, k, m = [fit.q.T @ fit.q for fit in fits], fits[0].q.shape[1], len(x)
    # one product for all fits
    xq = np.matmul(x, np.hstack([fit.q for fit in fits]), out=room("xq", m, k * len(fits)))
    a = room("a", len(fits), k, m)
    np.copyto(a.reshape(len(fits) * k, m), xq.T)
    first: dict[int, float] = {}
    found: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
    left, taken = list(range(len(fits))), [0] * len(fits)
    guess = [min(fit.steps[b], most) for fit in fits]
    tried = [min(n + 1, most) for n in guess]

    def of_q(own: list[np.ndarray]) -> list[np.ndarray]:
        """F'X and F'F of this task for each, X read once."""
        kept = room("kept", len(own), k, m)
        for j, anc in enumerate(own):
            kept[j] = anc
        fx = (kept.reshape(len(own) * k, m) @ x).reshape(len(own), k, -1)
        return [p for j in range(len(own)) for p in (fx[j], kept[j] @ kept[j].T)]

    while left:
        steps, norms = {}, []
        for i in left:
            steps[i], found_norms = _tried(fits[i].anc[b], a[i], grams[i], tried[i], room, i)
            norms.append(found_norms)
        got = sums(*norms, *of_q([steps[i][guess[i] - 1] for i in left]))
        for j, i in enumerate(list(left)):
            norm, fx, ff = np.sqrt(got[j]), *got[len(norms) + 2 * j : len(norms) + 2 * j + 2]
            first.setdefault(i, norm[0])
            small = np.flatnonzero(norm <= 0.1 * first[i])
            n = small[0] + 1 if len(small) else len(norm)
            np.copyto(fits[i].anc[b], steps[i][n - 1])
            if len(small) or taken[i] + n == most:
                left.remove(i)
                fits[i].steps[b] = int(taken[i] + n)
                found[i] = (fx, ff) if n == guess[i] else None
            taken[i] += n
            guess[i] = tried[i] = min(TRIED, most - taken[i])
    if late := [i for i in sorted(found) if found[i] is None]:
        got = sums(*of_q([fits[i].anc[b] for i in late]))
        found |= {i: (got[2 * j], got[2 * j + 1]) for j, i in enumerate(late)}
    return [found[i] for i in range(len(fits))]


def _q_steps(fit: _Fit, xf: np.ndarray, ff: np.ndarray, most: int) -> None:
    """``q_step`` until a step is at most a tenth of the first; every task takes them, and there are many, so few calls are made."""
    q, first = fit.q, None
    for _ in range(most):
        below = q @ ff
        below += fit.alpha
        new = q * xf
        new /= below
        np.maximum(new, LOW, out=new)
        np.minimum(new, 1.0 - LOW, out=new)
        new /= np.add.reduce(new, axis=1, keepdims=True)
        far = (new - q).ravel()
        norm = math.sqrt(far @ far)
        q = new
        first = norm if first is None else first
        if norm <= 0.1 * first:
            break
    fit.q = q


def _rounds(fits: list[_Fit], xs: list[np.ndarray], sizes: np.ndarray, most: int, stage: tuple[int, float], tol: float, sums: Sums) -> None:
    """Rounds over the batches for every fit that isn't done, up to the end of the ``stage``; the same in all tasks but for their sites."""
    began, room = time.monotonic(), _Room()
    if not sizes.any():
        for fit in fits:
            fit.done = True
    while active := [fit for fit in fits if not fit.done and fit.rounds < most]:
        before = [fit.q for fit in active]
        samples, k = before[0].shape
        for b, m in enumerate(int(x) for x in sizes):
            if not m:
                continue
            found = _anc_steps(active, b, xs[b], 2 * (1 + (samples * m + samples * k) // (m * k + m)), sums, room)
            for fit, (fx, ff) in zip(active, found, strict=True):
                _q_steps(fit, fx.T, ff, 2 * (1 + (samples * m + m * k) // (samples * k + samples)))
        for fit, q in zip(active, before, strict=True):
            fit.rounds += 1
            fit.done = float(np.sqrt(((fit.q - q) ** 2).mean())) < tol
        if active[0].rounds % stage[0] == 0:
            (late,) = sums(np.array([float(sums.rank == 0 and time.monotonic() - began >= stage[1])]))
            if late[0]:  # by the first task's clock, for all
                break


def _fit_quality(c: Columns, anc: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log-likelihood and squared distance from pi of a batch of sites."""
    x, l0, l1 = anc @ q.T, c["l0"], c["l1"]
    likely = np.log(l0 * (1 - x) ** 2 + 2 * l1 * x * (1 - x) + (1 - l0 - l1) * x**2).sum()
    return np.array([likely, ((x - c["pi"]) ** 2).sum()])


CELL_COLUMNS = ("l0", "l1", "pi")
#: What a stage writes: ``anc`` of all fits, and in the row without site each fit's Q, rounds, end and quality.
SCHEMA = f"site_idx long, anc {ARRAY}, state {ARRAY}"


def _stage(rows: DataFrame, states: list[tuple], batches: int, most: int, stage: tuple[int, float], tol: float, seed: int) -> DataFrame:
    """``anc`` of all fits over ``rows`` (site_idx, l0, l1, pi, batch, and anc if it isn't to be drawn) at the end of a stage."""
    samples, k = states[0][1].shape
    names, drawn = rows.columns, "anc" not in rows.columns

    def batch_of(sites: pa.Array, anc: pa.Array, state: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([sites, anc, state], ["site_idx", "anc", "state"])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {n: [] for n in names}
        for came in incoming:
            if came.num_rows:
                for n, c in zip(names, came.columns, strict=True):
                    held[n].append(np.array(to_numpy(c)))  # a copy: Arrow's batch can go

        def taken(name: str, empty: np.ndarray) -> np.ndarray:
            parts = held.pop(name)
            return np.concatenate(parts) if parts else empty

        site, batch = taken("site_idx", np.zeros(0, np.int64)), taken("batch", np.zeros(0, np.int32))
        order = np.lexsort((site, batch))
        site, batch = site[order], batch[order]
        cols = {c: taken(c, np.zeros((0, samples)))[order] for c in CELL_COLUMNS}
        if drawn:
            anc = np.tile(_clamp(_uniform(site, k, seed)), len(states))
        else:
            anc = taken("anc", np.zeros((0, k * len(states))))[order]
        cuts = np.searchsorted(batch, np.arange(batches + 1))
        parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        xs = [cols["pi"][x] for x in parts]
        fits = [
            _Fit(alpha, q, [np.ascontiguousarray(anc[x, n * k : (n + 1) * k].T) for x in parts], rounds, done)
            for n, (alpha, q, rounds, done) in enumerate(states)
        ]
        del anc
        with Sums() as sums:
            (sizes,) = sums(np.diff(cuts))
            _rounds(fits, xs, sizes, most, stage, tol, sums)
            anc = np.hstack([np.concatenate(fit.anc, axis=1).T for fit in fits])
            quality = np.zeros((len(fits), 2))
            for i in range(0, len(anc), 2048):
                part = {n: cols[n][i : i + 2048] for n in CELL_COLUMNS}
                for n, fit in enumerate(fits):
                    quality[n] += _fit_quality(part, anc[i : i + 2048, n * k : (n + 1) * k], fit.q)
            (quality,) = sums(quality)
            rank = sums.rank
        for i in range(0, len(anc), 2048):
            sites = pa.array(site[i : i + 2048])
            yield batch_of(sites, to_arrow(anc[i : i + 2048]), pa.nulls(len(sites), pa.list_(pa.float64())))
        if rank == 0:
            state = [np.array([*fit.q.ravel(), fit.rounds, fit.done, *x], np.float64) for fit, x in zip(fits, quality, strict=True)]
            yield batch_of(pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), to_arrow(np.concatenate(state)[None, :]))

    return rows.mapInArrow(run, SCHEMA, barrier=True)


@contextmanager
def fits_over(
    panel: DataFrame,
    samples: int,
    k: int,
    tol: float = 1e-5,
    most_rounds: int = 500,
    batches: int = 10,
    seed: int = 0,
    rounds_per_stage: int = ROUNDS_PER_STAGE,
    tasks: int | None = None,
    seconds_per_stage: float = SECONDS_PER_STAGE,
) -> Iterator[Callable[[Sequence[float]], list[Admixture]]]:
    """A function that fits each of some alphas to pi of a panel (site_idx, l0, l1, pi), side by side.

    The panel is worked out and dealt to tasks once, and stays with the executors for all calls. Every task of a
    call holds its sites in memory, 24 bytes a cell; there are ``tasks`` of them, by default as many as can run at the first call.
    Empty batches are left out. The state is written to the shared folder as ``ROUNDS_PER_STAGE`` says, from where the next stage goes on.
    """
    spark = panel.sparkSession
    cells = panel.select("site_idx", *(F.col(c).cast(ARRAY).alias(c) for c in CELL_COLUMNS))
    # a batch is a range of hashes: about equal in size whatever the site numbers are
    batch = F.pmod(F.xxhash64("site_idx", F.lit(seed)), F.lit(batches)).cast("int").alias("batch")
    _, start = initial(panel, samples, k, seed)
    held: list[tuple[int, DataFrame]] = []

    def dealt() -> tuple[int, DataFrame]:
        most = tasks or slots(spark)
        if held and held[0][0] > most:  # fewer tasks can run than before
            held.pop()[1].unpersist()
        if not held:
            rows = cells.select("*", batch).repartition(most, "site_idx")
            held.append((most, rows.persist(StorageLevel.MEMORY_AND_DISK)))
        return held[0]

    def fits(alphas: Sequence[float]) -> list[Admixture]:
        states, done = [(alpha, start, 0, False) for alpha in alphas], None
        while True:
            n, rows = dealt()
            if done is not None:
                rows = rows.join(done.repartition(n, "site_idx").hint("merge"), "site_idx")
            path = shared_path(spark, "admix")
            _stage(rows, states, batches, most_rounds, (rounds_per_stage, seconds_per_stage), tol, seed).write.parquet(path)
            wrote = spark.read.schema(SCHEMA).parquet(path)
            state = np.array(wrote.where("site_idx IS NULL").first()["state"]).reshape(len(alphas), -1)
            done = wrote.where("site_idx IS NOT NULL").select("site_idx", "anc")
            states = [(a, x[:-4].reshape(samples, k), int(x[-4]), bool(x[-3])) for a, x in zip(alphas, state, strict=True)]
            if all(end or rounds >= most_rounds for _, _, rounds, end in states):
                break
        both = cells.join(done, "site_idx")
        return [
            Admixture(q, both.withColumn("anc", F.slice("anc", n * k + 1, k)), float(x[-2]), float(np.sqrt(x[-1])), rounds, end)
            for n, ((_, q, rounds, end), x) in enumerate(zip(states, state, strict=True))
        ]

    try:
        yield fits
    finally:
        for _, rows in held:
            rows.unpersist()


def admix_many(panel: DataFrame, samples: int, k: int, alphas: Sequence[float], *settings, **options) -> list[Admixture]:
    """A fit for each alpha; settings and options as in ``fits_over``."""
    with fits_over(panel, samples, k, *settings, **options) as fits:
        return fits(alphas)


def admix(panel: DataFrame, samples: int, k: int, alpha: float = 0.0, **options) -> Admixture:
    """Factorise pi of a panel (site_idx, l0, l1, pi); options as in ``fits_over``."""
    return admix_many(panel, samples, k, [alpha], **options)[0]


def alpha_search(fits: Callable[[list[float]], list[Admixture]], end: float, depth: int = 7) -> tuple[float, Admixture]:
    """The regularisation with the highest log-likelihood, by halving steps.

    0, end / 2 and end are tried first and the best is the centre; then at every depth a
    lower and, if that doesn't help, a higher value; both are fitted together. If 0 is the best of the three, only the
    middle between 0 and the upper edge is tried, and the edge comes down to it at every depth, whether or not it
    was better. The end is soft: a higher value may exceed it.
    """
    first = [0.0, end / 2.0, end]
    tried = dict(zip(first, fits(first), strict=True))
    best = max(tried, key=lambda a: (tried[a].log_likelihood, -a))
    found = tried[best]
    edge, step = (end / 2.0 if best == 0.0 else None), end / 4.0
    for _ in range(depth - 1):
        if edge is not None:
            edge /= 2.0
            values = [edge]
        else:
            values = [max(best - step, 0.0), best + step]
            step /= 2.0
        for value, trial in zip(values, fits(values), strict=True):
            if trial.log_likelihood > found.log_likelihood:
                best, found = value, trial
                break
    return best, found
