"""Text in block gzip (BGZF): gzip members of at most 64 KB, each with its own size in its header.

Such a file can be read from the middle: a task looks for the first block at or after its range of
compressed bytes, and takes the lines that start after the first line break there, up to the one that starts where the
next range's first block does, or before it. A block is one only if it inflates to what its trailer says, so bytes that look like
a header inside compressed data are passed over. Writing is parallel too: tasks compress their
own lines to blocks, and the blocks are laid end to end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.passes import shared_path
from .files import write_ranges

MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes of text in a block that is written, and of a block at most.
TEXT, MOST = 65_280, 1 << 16
#: Compressed bytes of a range.
RANGE = 32 << 20


def block(data: bytes) -> bytes:
    """One block; that of no data marks the end of a file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(data: bytes, at: int = 0) -> int | None:
    """The size of the block whose header is at ``at``, None if there is none; the field ``BC`` has it."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    (length,) = struct.unpack_from("<H", data, at + 10)
    field, end = at + 12, at + 12 + length
    while field + 4 <= min(end, len(data)):
        (size,) = struct.unpack_from("<H", data, field + 2)
        if data[field : field + 2] == b"BC" and size == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def inflate(data: bytes) -> bytes | None:
    """The text of a whole block, None if it isn't one."""
    (extra,) = struct.unpack_from("<H", data, 10)
    try:
        text = zlib.decompress(data[12 + extra : -8], -15)
    except zlib.error:
        return None
    return text if struct.unpack("<II", data[-8:]) == (zlib.crc32(text), len(text) & 0xFFFFFFFF) else None


def first_block(f, at: int, size: int) -> int:
    """The first block at or after ``at``; ``size`` if there is none."""
    while at < size:
        f.seek(at)
        data = f.read(2 * MOST)  # whatever lies here, a block that begins in the first half is whole
        look = data.find(MAGIC)
        while 0 <= look < MOST:
            n = block_size(data, look)
            if n and len(data) >= look + n and inflate(data[look : look + n]) is not None:
                return at + look
            look = data.find(MAGIC, look + 1)
        at += MOST
    return size


def blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the blocks from ``at``, which is the start of one, to the end."""
    while at < size:
        f.seek(at)
        data = f.read(MOST)
        n = block_size(data)
        text = inflate(data[:n]) if n and n <= len(data) else None
        if text is None:
            raise ValueError(f"no block at byte {at}")
        yield at, text
        at += n


def lines_between(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """Lines of the range of compressed bytes from ``start`` to ``end``."""
    begin, stop = first_block(f, start, size), first_block(f, end, size)
    if begin >= stop:
        return
    rest, skip = b"", start > 0  # the line that begins at a range's first block belongs to the range before
    for at, text in blocks(f, begin, size):
        *whole, rest = (rest + text).split(b"\n")
        if at >= stop:  # the last line may run on into the next ranges
            if whole:
                if not skip:
                    yield whole[0]
                return
            continue
        if whole and skip:
            del whole[0]
            skip = False
        yield from whole
    if rest and not skip:
        yield rest


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class BlockReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[InputPartition]:
        from .text import file_system

        found = []
        for path in self.paths:
            system, inner = file_system(path)
            n = system.get_file_info(inner).size
            found += [_Part(path, i, min(i + self.size, n), n) for i in range(0, n, self.size)]
        return found or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from .text import file_system

        if not partition.size:
            return
        system, inner = file_system(partition.path)

        def batch(values: list[str]) -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array(values, pa.string()), pa.array([partition.path] * n), pa.array([partition.start] * n)]
            return pa.RecordBatch.from_arrays(columns, ["value", "path", "start"])

        with system.open_input_file(inner) as f:
            held, size = [], 0
            for line in lines_between(f, partition.start, partition.end, partition.size):
                held.append(line.decode("utf-8", "replace").removesuffix("\r"))
                size += len(line)
                if size > 1 << 22:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)


class BlockText(DataSource):
    """``spark.read.format("block_gzip").option("paths", ...)``: value, and the file and first byte of its range."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return "value string, path string, start long"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options["paths"].split("\n"), int(self.options["range"]))


def is_block_gzip(path: str) -> bool:
    """Whether a file starts with a block. Files that only Spark can open count as plain gzip."""
    from .text import file_system

    try:
        system, inner = file_system(path)
        with system.open_input_file(inner) as f:
            return block_size(f.read(1024)) is not None
    except (OSError, pa.ArrowException):
        return False


def read_lines(spark, paths: list[str], size: int = RANGE) -> DataFrame:
    """(value, path, start): the lines of block gzip files, in order within a range; each range is a task."""
    spark.dataSource.register(BlockText)
    return spark.read.format("block_gzip").option("paths", "\n".join(paths)).option("range", size).load()


def write_lines(ordered: DataFrame, path: str) -> None:
    """``ordered`` (value), in order within and over its partitions, as one block gzip file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, within, held = TaskContext.get().partitionId(), 0, bytearray()

        def out(data: bytes) -> pa.RecordBatch:
            made = block(data)
            columns = [pa.array([part]), pa.array([within]), pa.array([made])]
            return pa.RecordBatch.from_arrays(columns, ["part", "within", "data"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held += f"{value}\n".encode()
                while len(held) >= TEXT:
                    made = out(bytes(held[:TEXT]))
                    yield made
                    within += len(made.column(2)[0].as_py())
                    del held[:TEXT]
        if held:
            yield out(bytes(held))

    spark = ordered.sparkSession
    table = shared_path(spark, "blocks")
    ordered.select("value").mapInArrow(run, "part long, within long, data binary").write.parquet(table)
    made = spark.read.parquet(table)
    bases, total = [], 0
    for part, n in sorted(map(tuple, made.groupBy("part").agg(F.sum(F.octet_length("data"))).collect())):
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part long, base long")  # one row per partition
    rows = made.join(F.broadcast(base), "part").select((F.col("base") + F.col("within")).alias("at"), "data")
    end = spark.createDataFrame([(total, block(b""))], "at long, data binary")
    write_ranges(rows.unionByName(end), path, total + len(block(b"")))
