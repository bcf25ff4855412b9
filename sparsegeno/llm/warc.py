"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: each page is one record; of pages with equal payloads the one with the smallest
page_id is a ``response`` with the payload, the others are ``revisit`` records that name
it. Reading: the archives are cut at every occurrence of the magic, also inside payloads.
Each piece is a candidate record whose header says where its successor starts. Per file,
pointer jumping from offset 0 over (offset, successor) pairs finds the reachable
candidates; all others are payload and are joined to the record they lie in.

A file holds at most ``RECORDS_PER_FILE`` records; its candidate table has one row more, of a few numbers,
for each magic inside a payload. Only whole records that contain the magic are put together
again from pieces.

Defined results: a null html is an empty payload; a null page_id stays null and counts as
larger than any other; pages that repeat the smallest page_id with the same payload are
all ``response``. A null url is left out; line breaks in it are percent-encoded. An empty
table gives no archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, let, new_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_PER_FILE = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 given in hex: four groups of 40 bits, eight letters each."""

    def group(k: Column) -> Column:
        return F.conv(F.substring(sha1_hex, k * 10 + 1, F.lit(10)), 16, 10).cast("long")

    def letters(bits: Column) -> Column:
        return F.concat(
            *(
                F.substring(F.lit(BASE32), (F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
                for s in range(35, -1, -5)
            )
        )

    return F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda k: let(group(k), letters)), "")


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, first (the response's page_id)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumns(
        {"digest": base32(F.sha1(F.col("payload").cast("binary"))), "size": F.octet_length("payload").cast("long")}
    )
    again = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = cut(again.where("n > 1").drop("n"))
    few = again.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(again) if few else again, ["digest", "size"], "left")


def record(row: DataFrame) -> DataFrame:
    """The records as text: header, empty line, block; the writer adds the closing empty lines."""
    is_first = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    block = F.concat(F.lit(HTTP), F.when(is_first, F.col("payload")).otherwise(F.lit("")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(is_first, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-X-Payload-Bytes: "), F.col("size").cast("string")),
        F.when(~is_first, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.when(~is_first, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return row.select(F.concat(F.lit(MAGIC), lines, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    record(with_types(pages)).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Pointer jumping from offset 0: after k rounds all records within 2^k steps are known.

    ``offsets`` is sorted; a successor that is no candidate's offset ends the chain.
    """
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    ok = (at < n) & (offsets[np.minimum(at, n - 1)] == successors) & (successors > offsets)
    jump = np.append(np.where(ok, at, n), n)  # n: nowhere
    seen = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        seen[0] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        more[n] = False
        if (more == seen).all() and (jump == n).all():
            return seen[:n]
        seen, jump = more, jump[jump]


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of all archives below ``path`` with their offsets and headers.

    Pieces that look like whole records leave only digests (``mark`` is that of the piece);
    text is carried on only for the others.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        F.octet_length("value").cast("long").alias("len"),
        F.instr("value", END).alias("head_end"),
    )
    head = F.when(F.col("head_end") > 0, F.substring("value", F.lit(1), F.col("head_end") + 3)).otherwise("")
    raw = raw.withColumn("head", head)
    length = F.regexp_extract("head", r"(?:^|\r\n)Content-Length: ([0-9]{1,18})\r\n", 1)
    raw = raw.withColumns(
        {
            "head_len": F.octet_length("head").cast("long") + len(MAGIC),
            "content": F.when(length != "", length).cast("long"),
        }
    )
    whole = F.col("len") + len(MAGIC) == F.col("head_len") + F.col("content") + len(END)
    raw = raw.withColumn("whole", F.coalesce(whole, F.lit(False)))
    body = _payload(F.col("value"))
    out = raw.select(
        "file",
        "block",
        "nth",
        "len",
        "head",
        (F.col("head_len") + F.col("content") + len(END)).alias("span"),
        "whole",
        F.when(F.col("whole"), F.octet_length(body).cast("long")).alias("payload_bytes"),
        F.when(F.col("whole"), base32(F.sha1(body))).alias("sha1"),
        F.when(~F.col("whole"), F.col("value")).alias("value"),
        F.when(F.col("whole"), F.md5(F.col("value").cast("binary"))).alias("mark"),
    )
    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    # before the first magic there is an empty piece, so the first record starts at 0
    start = F.sum(F.col("len") + len(MAGIC)).over(order) - len(MAGIC)
    return out.withColumn("start", start)


def _payload(text: Column) -> Column:
    """What follows the WARC header and the HTTP header, without the closing line breaks, as bytes."""
    before = F.octet_length(F.substring_index(text, END, 2)) + len(END)
    return F.substring(text.cast("binary"), before + 1, F.greatest(F.octet_length(text) - before - len(END), F.lit(0)))


def _chains(pieces: DataFrame) -> DataFrame:
    """(file, start) of the records that the chain from the file's start reaches."""

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        start = rows["start"].to_numpy(np.int64)
        span = rows["span"].fillna(0).to_numpy(np.int64)
        good = reachable(start, start + span) & (span > 0)
        return pd.DataFrame({"file": key[0], "start": start[good]})

    links = pieces.where("start is not null").select("file", "start", "span")
    return links.groupBy("file").applyInPandas(walk, "file string, start long")


def _with_texts(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """``parts`` with the texts of pieces that look like records but lie in a payload.

    They are rare; only if there are any the archives are read once more for them.
    """
    lost = parts.where("whole").select("mark").distinct()
    if lost.isEmpty():
        return parts
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.md5(F.col("value").cast("binary")).alias("mark"), F.col("value").alias("again"))
    found = raw.join(lost, "mark", "left_semi").dropDuplicates(["mark"])
    return parts.join(found, "mark", "left").withColumn("value", F.coalesce("value", "again")).drop("again")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every verified record."""
    pieces = cut(read_pieces(spark, path))
    chains = _chains(pieces).withColumn("is_record", F.lit(True))
    pieces = pieces.where("start is not null").join(chains, ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    record = F.last(F.when(F.col("is_record"), F.col("start")), ignorenulls=True).over(order)
    pieces = cut(pieces.withColumn("record", record).where("record is not null"))
    single = pieces.where("is_record and whole").select("head", "payload_bytes", "sha1")
    parts = _with_texts(spark, path, pieces.where("not (coalesce(is_record, false) and whole)"))
    joined = parts.groupBy("file", "record").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC
        ).alias("text"),
        F.max(F.when(F.col("is_record"), F.col("head"))).alias("head"),
    )
    body = _payload(F.col("text"))
    joined = joined.select(
        "head", F.octet_length(body).cast("long").alias("payload_bytes"), base32(F.sha1(body)).alias("sha1")
    )
    rows = single.unionByName(joined)

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
        return F.when(got != "", got)

    def page(name: str) -> Column:
        got = F.regexp_extract(field(name), r"^<urn:page:(-?[0-9]+)>$", 1)
        return F.when(got != "", got).cast("long")

    first = F.col("record_type") == "response"
    return (
        rows.select(
            page("WARC-Record-ID").alias("page_id"),
            field("WARC-Type").alias("record_type"),
            page("WARC-Refers-To").alias("refers_to"),
            field("WARC-X-Payload-Bytes").cast("long").alias("full"),
            F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([A-Z2-7]{32})$", 1).alias("digest"),
            "payload_bytes",
            "sha1",
        )
        .select(
            "page_id",
            F.when(first, F.col("payload_bytes")).otherwise(F.col("full")).alias("payload_bytes"),
            F.when(first, F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages to the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
