"""Block gzip in ranges, single files written by many tasks, packed calls with push-down."""

from __future__ import annotations

import gzip
import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegeno.sources import block_gzip, files, sinks, text


def packed(data: bytes, sizes) -> bytes:
    out, at = b"", 0
    for n in sizes:
        out, at = out + block_gzip.block(data[at : at + n]), at + n
    return out + (block_gzip.block(data[at:]) if at < len(data) else b"") + block_gzip.block(b"")


def test_blocks_are_gzip():
    data = os.urandom(200_000)
    whole = packed(data, [65_280, 10, 0, 50_000, 65_280])
    assert gzip.decompress(whole) == data
    assert block_gzip.block(b"") == bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@pytest.mark.parametrize("seed", range(6))
def test_every_line_is_in_one_range(seed):
    """Lines over many blocks, blocks without line breaks, headers inside blocks, ranges smaller than blocks."""
    rng = random.Random(seed)
    false = block_gzip.block(b"not a block of the file")  # inside an incompressible text
    lines = [
        rng.choice([b"", b"x", b"word " * rng.randrange(60), bytes(rng.randrange(32, 127) for _ in range(rng.randrange(900)))])
        for _ in range(120)
    ]
    lines += [b"header " + false.replace(b"\n", b"") + bytes(rng.randrange(128, 256) for _ in range(40))]
    rng.shuffle(lines)
    data = b"\n".join(lines) + rng.choice([b"", b"\n"])
    sizes, left = [], len(data)
    while left > 0:
        sizes.append(rng.choice([1, 2, 30, 400, 3000]))
        left -= sizes[-1]
    whole = packed(data, sizes)
    want = data.split(b"\n")
    want = want[:-1] if not want[-1] else want
    for step in (17, 100, 999, len(whole)):
        got = []
        for i in range(0, len(whole), step):
            got += block_gzip.lines_between(io.BytesIO(whole), i, min(i + step, len(whole)), len(whole))
        assert got == want


def test_broken_block():
    whole = packed(b"a\n" * 5000, [4000, 4000])
    cut = whole[:-40]
    with pytest.raises(ValueError, match="no block"):
        list(block_gzip.lines_between(io.BytesIO(cut), 0, len(cut), len(cut)))


def test_block_gzip_table(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 50) for i in range(4000)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i long, value string")
    path = str(tmp_path / "x.gz")
    block_gzip.write_lines(rows.repartitionByRange(5, "i").sortWithinPartitions("i"), path)
    with gzip.open(path, "rt", encoding="utf-8") as f:
        assert f.read().splitlines() == lines
    back = text.numbered_lines(spark, path, 2000)
    assert block_gzip.read_lines(spark, [path], 2000).rdd.getNumPartitions() > 4
    assert [tuple(r) for r in back.orderBy("line").collect()] == list(enumerate(lines))
    (tmp_path / "two").mkdir()
    for i in (0, 1):
        (tmp_path / "two" / f"{i}.gz").write_bytes(packed(f"a{i}\r\nb{i}".encode(), [3]))
    both = text.numbered_lines(spark, str(tmp_path / "two"))
    assert [r["value"] for r in both.orderBy("line").collect()] == ["a0", "b0", "a1", "b1"]
    with gzip.open(tmp_path / "plain.gz", "wt") as f:
        f.write("\n".join(lines))
    assert not block_gzip.is_block_gzip(str(tmp_path / "plain.gz"))
    plain = text.numbered_lines(spark, str(tmp_path / "plain.gz"))
    assert [r["value"] for r in plain.orderBy("line").collect()] == lines


def left(folder) -> list[str]:
    return sorted(p.name for p in folder.iterdir())


def test_npy(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(57, 5))
    rows = spark.createDataFrame([(3 * i, v.tolist(), float(v[0])) for i, v in enumerate(x)], "site_idx long, e array<double>, f double")
    rows = rows.repartition(7)
    for kind in ("<f4", "<f8"):
        path = f"{tmp_path}/e{kind[1:]}.npy"
        sinks.write_npy(rows, "e", path, kind)
        assert np.array_equal(np.load(path), x.astype(kind))
    sinks.write_npy(rows, "f", f"{tmp_path}/f.npy", "<f8")
    assert np.array_equal(np.load(f"{tmp_path}/f.npy"), x[:, 0])
    calls = rows.select("site_idx", F.transform("e", lambda v: F.when(v > 0, 2).otherwise(-9).cast("byte")).alias("c"))
    sinks.write_npy(calls, "c", f"file://{tmp_path}/c.npy", "|i1")
    found = np.load(f"{tmp_path}/c.npy")
    assert found.dtype == np.int8 and np.array_equal(found, np.where(x > 0, 2, -9))
    back = files.read_npy(spark, f"{tmp_path}/ef8.npy", 10).orderBy("pos").collect()
    assert np.array_equal([r["values"] for r in back], x)
    sinks.write_npy(rows.where("site_idx < 0"), "f", f"{tmp_path}/none.npy")
    assert np.load(f"{tmp_path}/none.npy").shape == (0,)
    assert left(tmp_path) == ["c.npy", "ef4.npy", "ef8.npy", "f.npy", "none.npy"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(0, b"ab"), (2, b"cd")], "at long, data binary")
    with pytest.raises(Exception, match="4 of 6 bytes"):  # a gap
        files.write_ranges(rows, path, 6)
    assert left(tmp_path) == []
    bad = rows.withColumn("data", F.when(F.col("at") == 2, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        files.write_ranges(bad, path, 4)
    assert left(tmp_path) == []
    files.write_ranges(rows, path, 4)
    assert (tmp_path / "x").read_bytes() == b"abcd"
    with pytest.raises(FileExistsError):
        files.write_ranges(rows, path, 4)
    assert left(tmp_path) == ["x"]
    with pytest.raises(ValueError, match="mounted"):
        files.write_ranges(rows, "s3://bucket/x", 4)


def test_a_second_write_changes_nothing(spark, tmp_path):
    prefix, width = str(tmp_path / "calls"), 2
    rows = spark.createDataFrame([(5 * i, bytes([i, 255 - i])) for i in range(40)], "site_idx long, codes binary").repartition(6)
    sinks.write_plink(rows, 7, prefix)
    before = (tmp_path / "calls.bed").read_bytes()
    assert before == sinks.BED_HEADER + b"".join(bytes([i, 255 - i]) for i in range(40))
    for there in ("calls.bed", "calls.fam"):
        with pytest.raises(FileExistsError):
            sinks.write_plink(rows.limit(3), 7, prefix)
        assert left(tmp_path) == sorted({"calls.bed", "calls.fam"} & set(left(tmp_path)))
        if there == "calls.bed":
            assert (tmp_path / "calls.bed").read_bytes() == before
            os.remove(tmp_path / "calls.bed")
    with pytest.raises(Exception, match="fit the number"):
        sinks.write_plink(rows, 7 + 4 * width, str(tmp_path / "other"))
    assert left(tmp_path) == ["calls.fam"]


@pytest.fixture(scope="module")
def bed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bed")
    (folder / "x.bed").mkdir()
    rng, parts = np.random.default_rng(4), []
    for i, n in enumerate((100, 1, 57)):
        parts.append(rng.integers(0, 256, (n, 3), np.uint8))
        (folder / "x.bed" / f"part-{i}.bed").write_bytes(sinks.BED_HEADER + parts[-1].tobytes())
    (folder / "x.fam").write_text("s\n" * 10)
    return str(folder / "x"), np.concatenate(parts)


@pytest.mark.parametrize(
    ("where", "sites"),
    [
        (None, range(158)),
        ("site_idx < 30", range(30)),
        ("site_idx >= 99 AND site_idx <= 102", range(99, 103)),
        ("site_idx > 150 AND octet_length(codes) = 3", range(151, 158)),
        ("site_idx IN (3, 120) AND site_idx IS NOT NULL", (3, 120)),
        ("site_idx = 100", (100,)),
        ("site_idx > 900", ()),
    ],
)
def test_bounds_reach_the_reader(spark, bed, where, sites):
    prefix, codes = bed
    rows = text.packed_calls(spark, f"{prefix}.bed", 10, size=30)
    rows = rows.where(where) if where else rows
    got = {r["site_idx"]: r["codes"] for r in rows.collect()}
    assert got == {i: codes[i].tobytes() for i in sites}
    parts = rows.rdd.getNumPartitions()
    span = max(sites, default=0) - min(sites, default=0) + 1
    assert parts <= -(-span // 10) + 3  # ranges of ten sites


def test_a_mask_limits_what_is_read(spark, bed):
    prefix, codes = bed
    mask = spark.range(158).select(F.col("id").alias("site_idx"), F.col("id").isin(40, 42).cast("int").alias("keep"))
    rows = text.scan_plink(spark, prefix, site_mask=mask, size=30).orderBy("site_idx").collect()
    assert [r["site_idx"] for r in rows] == [40, 42]
    table = text.call_likelihoods(0.0)
    want = [table[(codes[40][s // 4] >> 2 * (s % 4)) & 3, 0] for s in range(10)]
    assert rows[0]["l0"] == pytest.approx(want)


def test_ranges_have_a_size_in_bytes_however_many_samples(tmp_path):
    samples = 400_000
    path = tmp_path / "wide.bed"
    with open(path, "wb") as f:
        f.write(sinks.BED_HEADER)
        f.truncate(3 + 50 * samples // 4)
    reader = text.BedReader(str(path), samples, 1 << 20)
    parts = reader.partitions()
    assert sum(p.count for p in parts) == 50 and max(p.count for p in parts) == (1 << 20) // (samples // 4)
    assert all(b.nbytes < 1.1 * reader.BATCH for b in reader.read(parts[0]))
