"""Results as files: Parquet for further work, ordered text and .npy for other programs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passes import to_numpy
from .block_gzip import write_lines
from .files import mounted, npy_header, refuse, write_ranges
from .text import dense_positions

DIGITS = 7
#: The first bytes of a file of packed calls, sites in order.
BED_HEADER = b"\x6c\x1b\x01"


def _shown(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def _ordered(rows: DataFrame, by: list[str], line: Column, path: str, files: int | None) -> None:
    ranged = rows.select(*by, line.alias("value"))
    ranged = ranged.repartitionByRange(files, *by) if files else ranged.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).select("value").write.mode("error").text(path)


def write_site_vector(panel: DataFrame, column: str, path: str, files: int | None = None, digits: int = DIGITS) -> None:
    """One number per line in the order of sites (frequencies, inbreeding, likelihood ratios)."""
    _ordered(panel, ["site_idx"], _shown(F.col(column), digits), path, files)


def write_site_flags(kept: DataFrame, path: str, files: int | None = None) -> None:
    """0 or 1 per original site."""
    _ordered(kept, ["site_idx"], F.col("keep").cast("string"), path, files)


def write_site_matrix(panel: DataFrame, column: str, path: str, files: int | None = None, digits: int = DIGITS) -> None:
    """One line per site of an array column (scans, weights, ancestral frequencies)."""
    line = F.array_join(F.transform(column, lambda x: _shown(x, digits)), " ")
    _ordered(panel, ["site_idx"], line, path, files)


def write_posteriors(panel: DataFrame, path: str, files: int | None = None) -> None:
    """Three tab-separated numbers per sample, six digits; neither header nor markers."""
    cells = F.transform(
        F.arrays_zip("p0", "p1", "p2"), lambda x: F.concat_ws("\t", *(_shown(x[n], 6) for n in ("p0", "p1", "p2")))
    )
    _ordered(panel, ["site_idx"], F.array_join(cells, "\t"), path, files)


def write_cells(cells: DataFrame, path: str, files: int | None = None, digits: int = DIGITS) -> None:
    """A samples-by-samples (or by-components) matrix given as (i, j, v), one line per i."""
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    line = F.array_join(F.transform("r", lambda x: _shown(x["v"], digits)), " ")
    _ordered(rows, ["i"], line, path, files)


def write_beagle(panel: DataFrame, path: str, block_gzip: bool = False) -> None:
    """A likelihood table: text files that follow each other by name, the first with the header.

    ``block_gzip``: one file in block gzip, written by all tasks, for programs that read such tables.
    """
    cell = F.transform(
        F.arrays_zip("l0", "l1"),
        lambda x: F.concat_ws("\t", x["l0"].cast("string"), x["l1"].cast("string"), (1.0 - x["l0"] - x["l1"]).cast("string")),
    )
    line = F.concat_ws("\t", F.col("site_idx").cast("string"), F.lit("0"), F.lit("1"), F.array_join(cell, "\t"))
    samples = panel.select(F.size("l0")).first()
    n = samples[0] if samples else 0
    header = "\t".join(["marker", "allele1", "allele2", *(f"Ind{i}" for i in range(n) for _ in range(3))])
    rows = panel.select("site_idx", line.alias("value"))
    head = panel.sparkSession.createDataFrame([(-1, header)], "site_idx long, value string")
    both = head.unionByName(rows)
    both = both.repartitionByRange("site_idx").sortWithinPartitions("site_idx").select("value")
    if block_gzip:
        write_lines(both, path)
    else:
        both.write.text(path)


def write_npy(panel: DataFrame, column: str, path: str, kind: str = "<f4") -> DataFrame:
    """A column, numbers or arrays over samples, as one .npy file with the sites in order; all tasks write to it.

    ``kind`` is the type of the numbers in NumPy's notation. ``panel`` is worked out once. Returns (site_idx, pos): each site's row.
    """
    refuse(path)
    places = dense_positions(panel.select("site_idx", column))
    first, sites = places.select(column).first(), places.count()
    flat = first is None or not isinstance(first[0], list)
    shape = (sites,) if flat else (sites, len(first[0]))
    header, width = npy_header(shape, kind), np.dtype(kind).itemsize * (1 if flat else shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.ascontiguousarray(to_numpy(batch.column(1)).astype(kind))
            pos = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1), len(pos)]  # rows that follow each other are written at once
            at = pa.array([len(header) + width * int(pos[i]) for i in cuts[:-1]], pa.int64())
            data = pa.array([values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([at, data], ["at", "data"])

    ranges = places.select("pos", column).mapInArrow(run, "at long, data binary")
    write_ranges(ranges, path, len(header) + width * shape[0], header)
    return places.select("site_idx", "pos")


def write_plink(rows: DataFrame, samples: int, prefix: str) -> None:
    """(site_idx, codes) as prefix.bed, the sites in order, and prefix.fam; fails before it touches anything if one is there."""
    refuse(f"{prefix}.bed", f"{prefix}.fam")
    width = -(-samples // 4)
    fits = F.when(F.octet_length("codes") == width, F.col("codes")).otherwise(
        F.raise_error(F.lit("the packed calls don't fit the number of samples")).cast("binary")
    )
    places = dense_positions(rows.select("site_idx", "codes"))
    ranges = places.select((F.col("pos") * width + len(BED_HEADER)).alias("at"), fits.alias("data"))
    write_ranges(ranges, f"{prefix}.bed", len(BED_HEADER) + width * places.count(), BED_HEADER)
    with open(mounted(f"{prefix}.fam"), "x") as f:  # one line per sample
        f.writelines(f"{i} {i} 0 0 0 -9\n" for i in range(samples))


def write_table(df: DataFrame, path: str) -> None:
    """Parquet: calls, dosages, individual frequencies and whatever Spark reads next."""
    df.write.mode("error").parquet(path)
