"""Text and binary inputs: likelihood tables, hard calls, masks, vectors, names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..functions.passes import CELLS, shared_path, to_arrow
from .block_gzip import RANGE, is_block_gzip, read_lines

THIRD = 0.333333
#: Endings of files that one task has to read from the start.
COMPRESSED = (".gz", ".bgz", ".deflate")


def numbered_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(line, value): the lines of one or more text files, numbered from 0 in order.

    Lines are counted per input split; only these counts (one row per split) reach the driver. Files in block gzip are
    read in ranges of ``size`` compressed bytes. Another compressed file cannot be split: it is read once, its lines are
    dealt out, ``size`` compressed bytes to a part, and written to the shared folder.
    """
    raw = spark.read.text(path)
    files = sorted(raw.inputFiles())
    packed = [name for name in files if name.endswith(COMPRESSED)]
    if packed and len(packed) == len(files) and all(map(is_block_gzip, files)):
        rows = read_lines(spark, files, size).select(
            "value", F.struct(F.col("path").alias("p"), F.col("start").alias("b")).alias("split"), F.monotonically_increasing_id().alias("nth")
        )
        packed = []
    else:
        rows = raw.select(
            "value",
            F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b")).alias("split"),
            F.monotonically_increasing_id().alias("nth"),
        )
    if packed:
        dealt, kept = shared_path(spark, "lines"), rows.schema
        lengths = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length")).first()[0]
        parts = max(2, -(-lengths // size))  # named, so that they are kept for few lines too
        rows.repartition(parts, "nth").write.parquet(dealt)
        rows = spark.read.schema(kept).parquet(dealt)
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.min("nth").alias("first")).collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: (r["split"]["p"], r["split"]["b"])):
        offsets.append((r["split"]["p"], r["split"]["b"], r["first"], total))
        total += r["n"]
    table = spark.createDataFrame(offsets, "p string, b long, first long, base long")
    keyed = rows.select("value", "nth", "split.p", "split.b")
    joined = keyed.join(F.broadcast(table), ["p", "b"])  # one row per split
    return joined.select((F.col("base") + F.col("nth") - F.col("first")).alias("line"), "value")


def tokens(value: Column) -> Column:
    """Fields separated by runs of tabs and spaces."""
    return F.split(F.trim(F.regexp_replace(value, r"[\t\r ]+", " ")), " ")


def scan_beagle(
    spark: SparkSession,
    path: str,
    site_mask: DataFrame | None = None,
    sample_mask: list[int] | None = None,
    check: bool = False,
    size: int = RANGE,
) -> DataFrame:
    """site_idx, l0, l1 from a likelihood table (plain, gzip or block gzip): a header, then per line a
    marker, two alleles and three likelihoods per sample.

    ``site_mask`` (site_idx, keep) is applied before any number is parsed; ``sample_mask``
    (0 or 1 per sample) drops samples, the rest are numbered anew. The third likelihood is
    never read; ``check`` fails on triples that don't sum to 1. ``size``: bytes of a range of a compressed file.
    """
    lines = numbered_lines(spark, path, size)
    rows = lines.where("line > 0").select((F.col("line") - 1).alias("site_idx"), "value")
    if site_mask is not None:
        rows = rows.join(site_mask.where("keep = 1").select("site_idx"), "site_idx", "left_semi")
    if sample_mask is not None and set(sample_mask) - {0, 1}:
        raise ValueError("a sample mask holds 0 and 1 only")

    def number(t: Column, i: Column, k: int) -> Column:
        return F.get(t, i * 3 + (k + 3)).cast("double")

    def arrays(t: Column) -> Column:
        if sample_mask is None:
            at = F.sequence(F.lit(0), (F.size(t) / 3).cast("int") - 2)
        else:
            at = F.array(*(F.lit(i) for i, keep in enumerate(sample_mask) if keep))
        parts = [
            F.transform(at, lambda i: number(t, i, 0)).alias("l0"),
            F.transform(at, lambda i: number(t, i, 1)).alias("l1"),
        ]
        if check:
            bad = F.exists(at, lambda i: F.abs(number(t, i, 0) + number(t, i, 1) + number(t, i, 2) - 1.0) > 1e-3)
            failed = F.raise_error(F.lit("likelihoods don't sum to 1")).cast("array<double>")
            parts[0] = F.when(bad, failed).otherwise(parts[0]).alias("l0")
        return F.struct(*parts)

    # the tokens are bound once per line, as the variable of a one-element transform
    cells = rows.select("site_idx", F.transform(F.array(tokens(F.col("value"))), arrays).getItem(0).alias("c"))
    return cells.select("site_idx", "c.l0", "c.l1")


def call_likelihoods(error: float) -> np.ndarray:
    """(l0, l1) of each two-bit code: 0 and 3 homozygous, 2 heterozygous, 1 missing."""
    e, ok = error, 1.0 - error
    return np.array(((ok * ok, 2 * e * ok), (THIRD, THIRD), (e * ok, ok * ok + e * e), (e * e, 2 * e * ok)))


def decode_bed(rows: DataFrame, samples: int, error: float = 0.0) -> DataFrame:
    """site_idx, l0, l1 from (site_idx, codes): packed bytes, two bits per sample, low bits first.

    Codes beyond the last sample are padding. One lookup for all sites of a batch.
    """
    table = call_likelihoods(error)
    width, shifts = -(-samples // 4), np.arange(0, 8, 2, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // samples)
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                packed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, width)
                codes = ((packed[:, :, None] >> shifts) & 3).reshape(len(packed), -1)[:, :samples]
                columns = [part.column(0), *(to_arrow(table[:, k][codes]) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["site_idx", "l0", "l1"])

    packed = rows.select(F.col("site_idx").cast("long"), "codes")
    return packed.mapInArrow(run, "site_idx long, l0 array<double>, l1 array<double>")


def file_system(path: str):
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


class _Range(InputPartition):
    """Some sites of a file: the file, its first site there, their number, and the first one's site_idx."""

    def __init__(self, path: str, first: int, count: int, site: int):
        self.path, self.first, self.count, self.site = path, first, count, site


class BedReader(DataSourceReader):
    """Ranges of whole sites of a .bed file, or of all in a folder; each task opens a file at its own offset.

    Ranges have at most ``size`` bytes (one site at least), and are read a batch at a time. Bounds on
    site_idx in a filter leave out ranges, and the sites outside them in the ranges at the edges, before anything is read.
    """

    #: Bytes of a batch.
    BATCH = 1 << 22

    def __init__(self, path: str, samples: int, size: int):
        self.path, self.width, self.size = path, -(-samples // 4), size
        self.first, self.end = 0, 2**63

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("site_idx",) or isinstance(value, bool):
                yield f
            elif isinstance(f, EqualTo) and isinstance(value, int):
                self._between(value, value + 1)
            elif isinstance(f, GreaterThan) and isinstance(value, int):
                self._between(value + 1, self.end)
            elif isinstance(f, GreaterThanOrEqual) and isinstance(value, int):
                self._between(value, self.end)
            elif isinstance(f, LessThan) and isinstance(value, int):
                self._between(self.first, value)
            elif isinstance(f, LessThanOrEqual) and isinstance(value, int):
                self._between(self.first, value + 1)
            elif isinstance(f, In) and value and all(isinstance(v, int) for v in value):
                self._between(min(value), max(value) + 1)
                yield f  # only its bounds are used here
            elif not isinstance(f, IsNotNull):
                yield f

    def _between(self, first: int, end: int) -> None:
        self.first, self.end = max(self.first, first), min(self.end, end)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = file_system(self.path)
        files = [system.get_file_info(inner)]
        if files[0].type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".bed")]
        found, site, step = [], 0, max(1, self.size // self.width)
        for f in sorted(files, key=lambda f: f.path):
            if (f.size - 3) % self.width:
                raise ValueError("the file's size doesn't fit the number of samples")
            sites = (f.size - 3) // self.width
            at, end = max(0, self.first - site), min(sites, self.end - site)
            found += [_Range(f.path, i, min(step, end - i), site + i) for i in range(at, end, step)]
            site += sites
        return found or [_Range(inner, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = file_system(self.path)
        step = max(1, self.BATCH // self.width)
        with system.open_input_file(partition.path) as f:
            f.seek(3 + partition.first * self.width)
            for i in range(0, partition.count, step):
                n = min(step, partition.count - i)
                data = f.read(n * self.width)
                sites = pa.array(np.arange(partition.site + i, partition.site + i + n))
                codes = pa.array([data[j : j + self.width] for j in range(0, len(data), self.width)], pa.binary())
                yield pa.RecordBatch.from_arrays([sites, codes], ["site_idx", "codes"])


class BedSource(DataSource):
    """``spark.read.format("packed_calls").option("samples", n).load(path)``; option size: bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "packed_calls"

    def schema(self) -> str:
        return "site_idx long, codes binary"

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options["path"], int(self.options["samples"]), int(self.options.get("size", RANGE)))


def packed_calls(spark: SparkSession, path: str, samples: int, size: int = RANGE) -> DataFrame:
    """(site_idx, codes) of a .bed file or a folder of them; comparisons of site_idx with numbers reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedSource)
    return spark.read.format("packed_calls").option("samples", samples).option("size", size).load(path)


def scan_plink(
    spark: SparkSession,
    prefix: str,
    error: float = 0.0,
    where: Column | str | None = None,
    site_mask: DataFrame | None = None,
    size: int = RANGE,
) -> DataFrame:
    """site_idx, l0, l1 from prefix.bed with as many samples as prefix.fam has lines.

    prefix.bed may be a folder of such files, one after the other in the order of their names. The path must be
    one that all executors can open (a shared or remote file system). ``where`` is a condition on site_idx that is applied as the
    file is read, ``site_mask`` (site_idx, keep) before anything is decoded; the numbers of sites stay those of the file.
    """
    samples = spark.read.text(f"{prefix}.fam").count()
    rows = packed_calls(spark, f"{prefix}.bed", samples, size)
    if where is not None:
        rows = rows.where(where)
    if site_mask is not None:
        kept = site_mask.where("keep = 1").select("site_idx")
        ends = kept.agg(F.min("site_idx"), F.max("site_idx")).first()
        if ends[0] is not None:  # what lies outside the mask is not even read
            rows = rows.where(F.col("site_idx").between(*ends))
        rows = rows.join(kept, "site_idx", "left_semi")
    return decode_bed(rows, samples, error)


def load_mask(spark: SparkSession, path: str) -> DataFrame:
    """(site_idx, keep) from one 0 or 1 per line; anything else is an error."""
    flag = F.trim("value")
    checked = F.when(flag.isin("0", "1"), flag.cast("int")).otherwise(F.raise_error(F.lit("a mask holds 0 and 1 only")))
    return numbered_lines(spark, path).select(F.col("line").alias("site_idx"), checked.alias("keep"))


def load_vector(spark: SparkSession, path: str, name: str = "lrt") -> DataFrame:
    """(pos, value) from one number per line, such as the likelihood ratios of an earlier run."""
    return numbered_lines(spark, path).select(F.col("line").alias("pos"), F.trim("value").cast("double").alias(name))


def attach_vector(panel: DataFrame, vector: DataFrame, name: str = "lrt") -> DataFrame:
    """``panel`` with a vector that is aligned with its sites in order; lengths must agree."""
    n, m = panel.count(), vector.count()
    if n != m:
        raise ValueError(f"{m} values for {n} sites")
    return dense_positions(panel).join(vector.select("pos", name), "pos").drop("pos")


def dense_positions(panel: DataFrame) -> DataFrame:
    """``panel`` with ``pos``, the rank of the site from 0.

    ``panel`` is worked out once and written to the shared folder, then sorted into ranges of sites, a file each; the rows of a
    file are numbered by Parquet, and each file starts after the counts of those before it (one row per file on the driver).
    """
    spark, kept, ordered = panel.sparkSession, shared_path(panel.sparkSession, "sites"), shared_path(panel.sparkSession, "ordered")
    panel.write.parquet(kept)
    once = spark.read.schema(panel.schema).parquet(kept)  # setting the ranges reads it twice
    once.repartitionByRange("site_idx").sortWithinPartitions("site_idx").write.parquet(ordered)
    rows = spark.read.schema(panel.schema).parquet(ordered)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__nth"))
    counts = placed.groupBy("__file").agg(F.count("*").alias("n"), F.min("site_idx").alias("s"))
    table, total = [], 0
    for r in sorted(counts.collect(), key=lambda r: r["s"]):
        table.append((r["__file"], total))
        total += r["n"]
    if not table:
        return rows.withColumn("pos", F.lit(0).cast("long"))
    bases = spark.createDataFrame(table, "__file string, __base long")
    out = placed.join(F.broadcast(bases), "__file")
    return out.select(*panel.columns, (F.col("__base") + F.col("__nth")).alias("pos"))


def load_names(spark: SparkSession, path: str | None, samples: int) -> DataFrame:
    """(sample_idx, name): one per line, or "1" to "N"."""
    if path is None:
        return spark.range(samples).select(F.col("id").cast("int").alias("sample_idx"), (F.col("id") + 1).cast("string").alias("name"))
    rows = numbered_lines(spark, path).select(F.col("line").cast("int").alias("sample_idx"), F.trim("value").alias("name"))
    if rows.count() != samples:
        raise ValueError("one name per sample is needed")
    return rows


def newick_tips(newick: str) -> list[tuple[str, int, float]]:
    """(name, depth, length) of the tips of a tree in Newick text; the root's children have depth 1."""
    out, depth = [], 0
    for mark, name, length in re.findall(r"([()])|([^\s(),:;]+):([^\s(),:;]+)", newick):
        depth += {"(": 1, ")": -1}.get(mark, 0)
        if name:
            out.append((name, depth, float(length)))
    return out


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """(name, depth, length) of each tip of a tree; a tree has one tip per sample."""
    newick = "".join(r["value"] for r in numbered_lines(spark, path).orderBy("line").collect())
    return spark.createDataFrame(newick_tips(newick), "name string, depth int, length double")
