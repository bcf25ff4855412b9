"""Single binary files that many tasks write at once, all or nothing.

Rows say which bytes belong where. They are written in place to a file of the final size under another name, so tasks that run
again, or twice at the same time, write the same bytes to the same places. Only when all bytes
are there does the file get its name; a write that fails leaves nothing. The folder must be one that
driver and executors mount (a local or network file system); object stores can't write in place.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.passes import CELLS, to_arrow


def mounted(path: str) -> str:
    """A path that ``open`` understands; other file systems are refused."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path}: only a mounted file system can be written in place")
    return re.sub("^file:/*", "/", path)


def refuse(*paths: str) -> None:
    """Fails if one of the files is there already, before anything is touched."""
    for path in paths:
        if os.path.exists(mounted(path)):
            raise FileExistsError(mounted(path))


@dataclass
class Written(WriterCommitMessage):
    size: int


class RangeWriter(DataSourceArrowWriter):
    """Writes (at, data) into a file beside ``path`` that takes its name on commit."""

    def __init__(self, path: str, header: bytes, size: int):
        self.path, self.size = mounted(path), size
        self.beside, self.header = f"{self.path}.{uuid.uuid4().hex}.part", header
        refuse(self.path)
        with open(self.beside, "xb") as f:
            f.write(header)
            f.truncate(size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = 0
        with open(self.beside, "r+b") as f:
            for batch in iterator:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    f.seek(at)
                    done += f.write(data.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = len(self.header) + sum(m.size for m in messages if m)
        try:
            if done != self.size or os.path.getsize(self.beside) != self.size:
                raise ValueError(f"{done} of {self.size} bytes were written")
            refuse(self.path)
        except BaseException:
            self.abort(messages)
            raise
        os.rename(self.beside, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.beside):
            os.remove(self.beside)


class RangeFile(DataSource):
    """``df.write.format("range_file")`` with the options path, header (hexadecimal) and size."""

    @classmethod
    def name(cls) -> str:
        return "range_file"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema, overwrite: bool) -> RangeWriter:
        return RangeWriter(self.options["path"], bytes.fromhex(self.options["header"]), int(self.options["size"]))


def write_ranges(rows: DataFrame, path: str, size: int, header: bytes = b"") -> None:
    """(at, data): bytes and their place in a file of ``size`` bytes that starts with ``header``."""
    refuse(path)
    rows.sparkSession.dataSource.register(RangeFile)
    out = rows.select("at", "data").write.format("range_file").mode("append")
    out.option("header", header.hex()).option("size", size).save(path)


def npy_header(shape: tuple[int, ...], kind: str) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
    return out.getvalue()


def read_npy(spark: SparkSession, path: str, sites: int = 1 << 14) -> DataFrame:
    """(pos, values) of a matrix, or (pos, value) of a vector, in a .npy file: each task maps its own rows."""
    whole = np.load(mounted(path), mmap_mode="r")
    n, flat, place = len(whole), whole.ndim == 1, mounted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(place, mmap_mode="r")
        for batch in batches:
            for first in batch.column(0).to_pylist():
                part = np.asarray(data[first : first + sites], np.float64)
                pos = pa.array(np.arange(first, first + len(part)))
                values = pa.array(part) if flat else pa.array(list(part), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pos, values], ["pos", "value" if flat else "values"])

    starts = spark.range(0, n, sites)
    return starts.mapInArrow(run, "pos long, value double" if flat else "pos long, values array<double>")


def read_npy_at(places: DataFrame, path: str) -> DataFrame:
    """(site_idx, values) of the matrix in a .npy file whose rows (site_idx, pos) are wanted: no row moves between tasks."""
    place = mounted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(place, mmap_mode="r")
        step = max(1, CELLS // max(1, data.shape[1]))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                values = to_arrow(np.asarray(data[part.column(1).to_numpy()], np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["site_idx", "values"])

    return places.select("site_idx", "pos").mapInArrow(run, "site_idx long, values array<double>")
