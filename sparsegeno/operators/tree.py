"""Neighbour joining on samples: distances in Spark, agglomeration of the small matrix on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Part of the largest value within which two values are equal.
TIE = 1e-9


def to_distance(cov: DataFrame) -> DataFrame:
    """(i, j, v): max(0, C_ii + C_jj - 2 C_ij)."""
    own = cov.where("i = j").select("i", F.col("v").alias("d"))
    rows = cov.join(F.broadcast(own.select("i", F.col("d").alias("di"))), "i")  # one row per sample
    rows = rows.join(F.broadcast(own.select(F.col("i").alias("j"), F.col("d").alias("dj"))), "j")
    return rows.select("i", "j", F.greatest(F.lit(0.0), F.col("di") + F.col("dj") - 2.0 * F.col("v")).alias("v"))


def q_matrix(distance: DataFrame) -> DataFrame:
    """(i, j, v): (n - 2) D_ij - r_i - r_j with row sums r, off the diagonal."""
    sums = distance.groupBy("i").agg(F.sum("v").alias("r"), F.count("*").alias("n"))
    rows = distance.where("i <> j").join(F.broadcast(sums), "i")
    other = sums.select(F.col("i").alias("j"), F.col("r").alias("s"))
    rows = rows.join(F.broadcast(other), "j")
    return rows.select("i", "j", ((F.col("n") - 2) * F.col("v") - F.col("r") - F.col("s")).alias("v"))


def reduce_distance(d: np.ndarray, a: int, b: int) -> np.ndarray:
    """The matrix without a and b, their parent last."""
    rest = [i for i in range(len(d)) if i not in (a, b)]
    new = np.maximum(0.0, 0.5 * (d[rest, a] + d[rest, b] - d[a, b]))
    out = np.zeros((len(rest) + 1,) * 2)
    out[:-1, :-1] = d[np.ix_(rest, rest)]
    out[-1, :-1] = out[:-1, -1] = new
    return out


def _closest(d: np.ndarray) -> tuple[int, int, float, float]:
    """The pair to join (the first in row order among equals) and its branch lengths.

    Values that differ by rounding only are equal: of four nodes two pairs always tie, and sums over
    sites arrive in any order.
    """
    n = len(d)
    r = d.sum(axis=1)
    q = (n - 2) * d - r[:, None] - r[None, :]
    near = TIE * np.abs(q).max()
    q[np.tril_indices(n)] = np.inf
    a, b = divmod(int((q <= q.min() + near).argmax()), n)
    x = max(0.0, float(0.5 * d[a, b] + (r[a] - r[b]) / (2.0 * (n - 2))))
    return a, b, x, max(0.0, float(d[a, b]) - x)


def neighbour_joining(d: np.ndarray, names: list[str]) -> tuple[str, list[tuple[str, str, float]]]:
    """Newick text and edges (parent, child, length) of at least three tips."""
    if len(d) < 3 or len(names) != len(d):
        raise ValueError("a tree needs three samples or more, and a name for each")
    labels, nodes, edges = list(names), list(names), []
    d = d.copy()
    while len(d) > 3:
        a, b, x, y = _closest(d)
        parent = f"node{len(names) - len(d) + 1}"
        edges += [(parent, nodes[a], x), (parent, nodes[b], y)]
        label = f"({labels[a]}:{x:.7g}, {labels[b]}:{y:.7g})"
        d = reduce_distance(d, a, b)
        rest = [i for i in range(len(labels)) if i not in (a, b)]
        labels = [labels[i] for i in rest] + [label]
        nodes = [nodes[i] for i in rest] + [parent]
    a, b, x, y = _closest(d)
    c = 3 - a - b
    z = max(0.0, float(0.5 * (d[a, c] + d[b, c] - d[a, b])))
    edges += [("root", nodes[a], x), ("root", nodes[c], z), ("root", nodes[b], y)]
    return f"({labels[a]}:{x:.7g}, {labels[c]}:{z:.7g}, {labels[b]}:{y:.7g});", edges
