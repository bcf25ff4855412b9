"""Passes over a panel: per-site columns without a shuffle, and sums over sites."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Columns = dict[str, np.ndarray]


def to_numpy(column: pa.Array) -> np.ndarray:
    """A column of numbers as a vector, a column of equally long lists as a matrix."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def to_arrow(values: np.ndarray) -> pa.Array:
    if values.ndim == 1:
        return pa.array(values)
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())


#: Sites, and cells, of the matrices that a task works on at once.
SITES, CELLS = 2048, 1 << 20


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold a bounded number of cells, however many samples there are."""
    for batch in batches:
        lists = [c for c in batch.columns if pa.types.is_list(c.type) and batch.num_rows]
        width = max((len(c[0]) for c in lists if c[0].is_valid), default=1)
        rows = max(1, min(SITES, CELLS // max(width, 1)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def with_site_columns(panel: DataFrame, make: Callable[[Columns], Columns], **kinds: str) -> DataFrame:
    """``panel`` with columns that depend on one site alone: a narrow pass.

    ``make`` gets the needed columns of a batch of sites as arrays; ``kinds`` names the
    new columns (replacing old ones) and their Spark types.
    """
    kept = [f for f in panel.schema.fields if f.name not in kinds]
    made = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items()]
    schema = T.StructType(kept + made)
    names = [f.name for f in schema.fields]
    n_kept = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            got = make({n: to_numpy(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            old = [batch.column(batch.schema.get_field_index(n)) for n in n_kept]
            yield pa.RecordBatch.from_arrays([*old, *(to_arrow(got[n]) for n in kinds)], names)

    return panel.mapInArrow(run, schema)


def site_sums(panel: DataFrame, make: Callable[[Columns], np.ndarray], mean: bool = False) -> DataFrame:
    """(i, j, v): the matrix that ``make`` gives for batches of sites, summed over all sites.

    Each task adds up its own batches. Their matrices, which are small (samples by a few), are shuffled by row,
    one array per row, and added as they arrive. Every row comes with the task's number of sites, so the
    ``mean`` per site needs no second pass. Products of samples with samples are the business of ``tile_sums``.
    """
    kind, names = "i int, v array<double>, sites long", ["i", "v", "sites"]

    def rows_of(at: list[int], values: np.ndarray, sites: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), to_arrow(values), pa.array(sites, pa.int64())], names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sites = None, 0
        for batch in _batches(batches):
            sites += batch.num_rows
            part = np.atleast_2d(make({n: to_numpy(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)}))
            total = part.astype(np.float64) if total is None else total + part
        for i in range(0, 0 if total is None else len(total), 256):
            values = total[i : i + 256]
            yield rows_of(list(range(i, i + len(values))), values, [sites] * len(values))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        sites: dict[int, int] = {}
        for batch in batches:
            for i, v, n in zip(batch.column(0).to_pylist(), to_numpy(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                total[i] = total[i] + v if i in total else v.copy()
                sites[i] = sites.get(i, 0) + n
        at = sorted(total)
        for k in range(0, len(at), 256):
            yield rows_of(at[k : k + 256], np.stack([total[i] for i in at[k : k + 256]]), [sites[i] for i in at[k : k + 256]])

    sums = panel.mapInArrow(own, kind).repartition("i").mapInArrow(added, kind)
    cells = sums.select("i", F.posexplode("v").alias("j", "v"), "sites")
    return cells.select("i", "j", (F.col("v") / F.col("sites") if mean else F.col("v")).alias("v"))


#: Samples of a tile: 32 MB of products.
TILE = 2048
#: What ``tile_sums`` gives: part of row i of the matrix, from column j0 on, and the number of sites that are in it.
STRIP = "i int, j0 int, v array<double>, sites long"


def tile_sums(
    panel: DataFrame, make: Callable[[Columns], tuple[np.ndarray, np.ndarray | None]], tile: int = TILE
) -> DataFrame:
    """(i, j0, v, sites): strips of E'E, samples by samples, summed over all sites.

    ``make`` gives E of a batch of sites, and the batch's sums for the diagonal if the diagonal is something else.
    Samples are cut into tiles. With one tile a task adds up the products of its own sites; with more, a batch goes to every pair
    of tiles in the upper triangle as the two parts of E that the pair needs, and is multiplied there. So no
    task ever holds more than one tile of the matrix. Partial tiles meet row by row, twice: several per pair first, so that a
    pair is not one task's work.
    """
    kind = "a int, b int, part int, n int, product boolean, first binary, second binary, diagonal binary, sites long"
    names = [x.split()[0] for x in kind.split(", ")]
    groups = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def row(*values) -> pa.RecordBatch:
        kinds = [*[pa.int32()] * 4, pa.bool_(), *[pa.binary()] * 3, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def raw(values: np.ndarray | None) -> bytes | None:
        return None if values is None else np.ascontiguousarray(values, np.float64).tobytes()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, on, sites = TaskContext.get().partitionId(), None, None, 0
        for batch in _batches(batches):
            if not batch.num_rows:
                continue
            e, diagonal = make({n: to_numpy(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            cuts = range(0, e.shape[1], tile)
            if len(cuts) == 1:
                total = e.T @ e if total is None else total + e.T @ e
                on = diagonal if on is None else on + diagonal
                sites += batch.num_rows
                continue
            pairs = len(cuts) * (len(cuts) + 1) // 2
            blocks = [raw(e[:, i : i + tile]) for i in cuts]
            for a, first in enumerate(blocks):
                for b in range(a, len(blocks)):
                    there = raw(diagonal[a * tile : (a + 1) * tile]) if a == b and diagonal is not None else None
                    second = blocks[b] if b > a else None
                    salt = part % max(1, groups // pairs)
                    yield row(a, b, salt, batch.num_rows, False, first, second, there, batch.num_rows)
        if total is not None:
            yield row(0, 0, part % groups, len(total), True, raw(total), None, raw(on), sites)

    def strips(at: int, j0: int, values: np.ndarray, sites: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(values), 256):
            v = values[i : i + 256]
            columns = [pa.array(range(at + i, at + i + len(v)), pa.int32()), pa.array([j0] * len(v), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, to_arrow(v), pa.array([sites] * len(v), pa.int64())], ["i", "j0", "v", "sites"]
            )

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, on, sites = None, None, None, 0

        def out() -> Iterator[pa.RecordBatch]:
            a, b, _ = key
            if on is not None:
                np.fill_diagonal(total, on)
            yield from strips(a * tile, b * tile, total, sites)
            if b > a:
                yield from strips(b * tile, a * tile, total.T, sites)

        for batch in batches:
            for i in range(batch.num_rows):
                a, b, part, n, product, *data, count = (c[i] for c in batch.columns)
                now = a.as_py(), b.as_py(), part.as_py()
                x, y, d = (np.frombuffer(v.as_buffer(), np.float64) if v.is_valid else None for v in data)
                x = x.reshape(n.as_py(), -1)
                if not product.as_py():
                    x = x.T @ (x if y is None else y.reshape(n.as_py(), -1))
                if now != key:
                    if key:
                        yield from out()
                    key, total, on, sites = now, np.zeros(x.shape), None, 0
                total += x
                on = d if on is None else on + d
                sites += count.as_py()
        if key:
            yield from out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, sites = None, None, 0
        for batch in batches:
            for i, j0, v, n in zip(*(to_numpy(c) if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                v = v.values.to_numpy()
                if (i, j0) == key:
                    total, sites = total + v, sites + n
                    continue
                if key:
                    yield from strips(*key, total[None, :], sites)
                key, total, sites = (int(i), int(j0)), v, int(n)
        if key:
            yield from strips(*key, total[None, :], sites)

    by = ["a", "b", "part"]
    tiles = panel.mapInArrow(own, kind).repartition(*by).sortWithinPartitions(*by).mapInArrow(multiplied, STRIP)
    return tiles.repartition("i", "j0").sortWithinPartitions("i", "j0").mapInArrow(added, STRIP)


def strip_cells(strips: DataFrame, mean: bool = False) -> DataFrame:
    """(i, j, v): the single cells of strips, or their means per site."""
    v = F.col("v") / F.col("sites") if mean else F.col("v")
    cells = strips.select("i", "j0", F.posexplode("v").alias("j", "v"), "sites")
    return cells.select("i", (F.col("j0") + F.col("j")).alias("j"), v.alias("v"))


def collect_matrix(cells: DataFrame) -> np.ndarray:
    """A samples-by-samples or samples-by-components matrix; the size never depends on sites."""
    rows = cells.select("i", "j", "v").toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    out = np.zeros((rows["i"].max() + 1, rows["j"].max() + 1))
    out[rows["i"], rows["j"]] = rows["v"]
    return out


def cells_of(panel: DataFrame, **columns: str) -> DataFrame:
    """Long form: site_idx, sample_idx and one value per named array column."""
    named = panel.select("site_idx", *(F.col(c).alias(n) for n, c in columns.items()))
    rows = named.select("site_idx", F.posexplode(F.arrays_zip(*columns)).alias("sample_idx", "x"))
    return rows.select("site_idx", "sample_idx", *(F.col(f"x.{n}").alias(n) for n in columns))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in a local session without it."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    if not held.isDefined():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
