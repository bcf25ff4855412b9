"""Packing of documents into fixed windows of tokens by deficit round-robin over source queues.

Every source is a queue of the tokens of its documents, one after the other. In each round a
queue earns its quantum, its target share of one window, and sends its next packets while its
saved-up credit, the deficit, covers them; what is left is carried to later rounds, windows and
partitions. A queue's packets are as long as its quantum, but at least ``grain`` tokens, so that
rare sources save up for a useful length. The packets in the order in which they are sent
fill one window after the other without a gap.

The credit after r rounds is r times the quantum, so a packet's round follows from its place in
its queue alone, and the place in its queue from sums by task. No task runs the rounds of others,
and no queue is gathered: the order is that of a range-partitioned sort of packets, and window
and offset come from sums over the sorted partitions. Token ids are written once, in two bytes
where the vocabulary allows it, and meet their pieces in one join.

Defined results: a null text is an empty one, which has the end id only. Null sources are a
queue of their own. Repeated rows are documents of their own. Within a queue documents keep the order
of the input's partitions. Strings of special tokens in a text are ordinary text. Only the
last sequence may hold fewer than ``window`` ids; it is padded unless its length is a power
of two. No documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, written

#: The id that ends each document.
END = 1
#: Words of at most this many characters are remembered, in two generations of this many each per worker.
MEMO_CHARS, MEMO_WORDS = 40, 400_000
#: Characters of a text, and of all texts, that are split into words at once.
SLAB, AT_ONCE = 1_000_000, 4_000_000
#: A word of Latin letters, one piece whatever stands around it, and at most one mark, a piece too.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARKS = ".,;:!?"
PLAIN = f"^(?P<word>[{LETTERS}]+)(?P<mark>[{MARKS}]?)$"


class WordEncoder:
    """Ids by the tokenizers library, with words between blanks remembered.

    The normaliser and the pattern of these files never join what a blank, tab or line feed
    separates, so a text's ids are those of its words, one after the other. A word of letters is lower-cased
    and goes to the library's model at once; all others go through the library's whole encoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.code = "H" if most < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.end = np.array([END], self.dtype).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.marks = [b"", *self.each(list(MARKS)).values()]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)]
        self.byte_level = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in latin}
        self.model = self.tokenizer.model

    def slabs(self, text: str) -> Iterator[str]:
        """``text`` in parts that end at a blank, tab or line feed."""
        text = text.replace("\n", " ").replace("\t", " ")
        at = 0
        while len(text) - at > SLAB:
            to = text.find(" ", at + SLAB)
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:]

    def each(self, words: list[str]) -> dict[str, bytes]:
        made = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, self.dtype).tobytes() for w, e in zip(words, made, strict=True)}

    def letters(self, word: str) -> bytes:
        """Ids of a word of lower-case Latin letters."""
        found = self.model.tokenize(word if word.isascii() else word.translate(self.byte_level))
        data = array(self.code, [x.id for x in found])
        if sys.byteorder == "big":
            data.byteswap()
        return data.tobytes()

    def remembered(self, words: list[str]) -> list[bytes | None]:
        """Ids of words as far as they are remembered."""
        if len(self.known) + len(words) > MEMO_WORDS:
            self.before, self.known = self.known, {"": b""}
        return [self.before.get(w) if ids is None else ids for w, ids in zip(words, map(self.known.get, words), strict=True)]

    def remember(self, words: Iterable[str], ids: Iterable[bytes]) -> None:
        self.known.update((w, b) for w, b in zip(words, ids, strict=True) if len(w) <= MEMO_CHARS)

    def distinct(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of parts of words, and for each of distinct words its two parts; the second may be empty."""
        plain = pc.extract_regex(words, PLAIN)
        lower = pc.utf8_lower(plain.field("word")).fill_null("").dictionary_encode()
        names = lower.dictionary.to_pylist()
        found = self.remembered(names)
        found = [self.letters(w) if ids is None else ids for w, ids in zip(names, found, strict=True)]
        self.remember(names, found)
        first = lower.indices.to_numpy().astype(np.int32)
        second = pc.index_in(plain.field("mark"), pa.array(["", *MARKS])).fill_null(0).to_numpy() + np.int32(len(found))
        found += self.marks
        where = np.flatnonzero(plain.is_null().to_numpy(zero_copy_only=False))
        others = words.take(pa.array(where)).to_pylist()
        ids = self.remembered(others)
        new = [w for w, b in zip(others, ids, strict=True) if b is None]
        new = self.each(new) if new else {}
        ids = [new[w] if b is None else b for w, b in zip(others, ids, strict=True)]
        self.remember(others, ids)
        first[where] = np.arange(len(found), len(found) + len(ids))
        return found + ids, first, second

    def flat(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part of a text, for all parts at once."""
        lists = pc.split_pattern(pa.array(parts, pa.string()), " ")
        words = lists.flatten().dictionary_encode()
        ids, first, second = self.distinct(words.dictionary)
        data = np.frombuffer(b"".join(ids), self.dtype)
        length = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        begin, nth = np.cumsum(length, dtype=np.int32) - length, words.indices.to_numpy()
        which = np.empty(2 * len(nth), np.int32)
        which[0::2], which[1::2] = first[nth], second[nth]
        each = length[which]
        ends = np.cumsum(each, dtype=np.int32)  # parts of AT_ONCE are far below 2^31 ids
        take = np.repeat(begin[which] - (ends - each), each)
        take += np.arange(len(take), dtype=np.int32)
        out = data[take]
        cuts = np.concatenate((np.zeros(1, np.int32), ends[1::2]))[lists.offsets.to_numpy()]
        return [out[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian integers."""
        out, held, owners, size = [], [], [], 0

        def flush():
            for i, ids in zip(owners, self.flat(held), strict=True):
                out[i].append(ids.tobytes())

        for i, text in enumerate(texts):
            out.append([])
            for part in self.slabs(text):
                if size + len(part) > AT_ONCE and held:
                    flush()
                    held, owners, size = [], [], 0
                held.append(part)
                owners.append(i)
                size += len(part)
        if held:
            flush()
        return [b"".join((*x, self.end)) for x in out]


_held: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def _default(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(block, row, doc_id, queue, n, before, ids) of every document, as a table of the shared folder.

    block is the task, row the document's number in it, and before the tokens of the same
    queue that its task has seen earlier.
    """
    path = _default(path)
    schema = "block long, row long, doc_id long, queue string, n long, before long, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, row, seen = _encoder(path), TaskContext.get().partitionId(), 0, {}
        width = encoder.dtype.itemsize
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids = encoder.encode(x.as_py() or "" for x in part.column(2))
                n, before = [len(x) // width for x in ids], []
                for queue, more in zip(part.column(1).to_pylist(), n, strict=True):
                    before.append(seen.get(queue, 0))
                    seen[queue] = before[-1] + more
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(n), pa.int64()),
                        pa.array(range(row, row + len(n)), pa.int64()),
                        part.column(0),
                        part.column(1),
                        pa.array(n, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names,
                )
                row += len(n)

    queue = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text").mapInArrow(run, schema)
    out = new_path(docs.sparkSession, "packing-tokens")
    read.write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(read.schema).parquet(out)


def queues(ids: DataFrame, window: int, targets: Mapping[str | None, float] | None) -> DataFrame:
    """(queue, block, base, held, quantum): where a task's tokens begin in their queue, and the queue's credit a round.

    One row per queue and task. Targets are shares of the tokens by source; without them, and for sources
    that they don't name, a source's share is what it holds.
    """
    per = written(ids.groupBy("queue", "block").agg(F.sum("n").alias("n")), "packing-blocks")
    whole = per.agg(F.sum("n")).first()[0] or 1
    held = per.groupBy("queue").agg(F.sum("n").alias("held"))
    share = F.col("held") / F.lit(float(whole))
    for source, goal in (targets or {}).items():
        if not goal > 0:
            raise ValueError("targets must be positive: every document is packed")
        share = F.when(F.col("queue") == ("" if source is None else f"={source}"), float(goal)).otherwise(share)
    held = held.select("queue", "held", share.alias("share"))
    total = held.agg(F.sum("share")).first()[0] or 1.0
    held = held.select("queue", "held", (F.col("share") * (window / total)).alias("quantum"))
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    return written(per.select("queue", "block", base).join(held, "queue"), "packing-queues")


def packets(ids: DataFrame, credit: DataFrame, grain: int) -> DataFrame:
    """(block, row, start, length, round, queue, place): the parts of documents that are sent together, with their round."""
    longest = F.greatest(F.col("quantum"), F.lit(float(grain)))  # a packet of the queue
    docs = (
        ids.select("block", "row", "queue", "n", "before")
        .join(credit, ["queue", "block"])
        .withColumns({"a": F.col("base") + F.col("before"), "size": longest})
        .withColumn("b", F.col("a") + F.col("n"))
    )

    def nth(place: Column) -> Column:
        return F.floor(place / F.col("size"))

    def packet(g: Column) -> Column:
        begin, end = F.floor(g * F.col("size")), F.floor((g + 1) * F.col("size"))
        # the first round whose credit covers the packet, or what is left of the queue
        covered = F.ceil(F.least(F.col("size") * (g + 1), F.col("held")) / F.col("quantum"))
        rnd = F.when(F.col("quantum") >= grain, g + 1).otherwise(covered)
        return F.struct(
            F.greatest(begin, F.col("a")).alias("p"), F.least(end, F.col("b")).alias("q"), rnd.cast("long").alias("round")
        )

    # one packet more on both sides, as quotients are rounded; those that miss the document are left out
    span = F.sequence(F.greatest(nth(F.col("a")) - 1, F.lit(0)), nth(F.col("b")) + 1)
    return (
        docs.withColumn("x", F.explode(F.transform(span, packet)))
        .where("x.p < x.q")
        .selectExpr(
            "block", "row", "x.p - a AS start", "x.q - x.p AS length", "x.round AS round", "queue", "x.p AS place"
        )
    )


def _sent(parts: DataFrame) -> DataFrame:
    """Packets with their place in the stream of all: sums within sorted partitions, then one number per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            length = batch.column(3).to_numpy()
            ends = seen + np.cumsum(length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.full(len(length), part)), pa.array(ends - length)],
                ["block", "row", "start", "length", "part", "within"],
            )
            seen = int(ends[-1]) if len(ends) else seen

    keys = ["round", "queue", "place"]
    ordered = parts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = "block long, row long, start long, length long, part long, within long"
    placed = written(ordered.select("block", "row", "start", "length").mapInArrow(run, schema), "packing-sent")
    sums = placed.groupBy("part").agg(F.sum("length")).collect()  # one number per partition of the sort
    at, first = 0, []
    for part, length in sorted(map(tuple, sums)):
        first.append((part, at))
        at += length
    first = F.broadcast(placed.sparkSession.createDataFrame(first, "part long, at long"))  # one row per partition
    return placed.join(first, "part").selectExpr("block", "row", "start", "length", "at + within AS at")


def pack(
    docs: DataFrame,
    window: int = 2048,
    grain: int = 128,
    targets: Mapping[str | None, float] | None = None,
    path: str | None = None,
) -> DataFrame:
    """doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Each window holds every source near its target share: packets are sent when their
    round's credit covers them, so what a source has sent differs from its target by less than a packet.
    """
    ids = tokens(docs, path)
    sent = _sent(packets(ids, queues(ids, window, targets), grain))
    width = F.lit(window)
    first, last = F.expr(f"at div {window}"), F.expr(f"(at + length - 1) div {window}")
    cut = (
        sent.withColumn("sequence_id", F.explode(F.sequence(first, last)))
        .withColumn("p", F.greatest("at", F.col("sequence_id") * width))
        .withColumn("q", F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * width))
        .selectExpr(
            "block", "row", "start + p - at AS start", "q - p AS length", "sequence_id", f"p - sequence_id * {window} AS offset"
        )
    )
    # at most one piece per packet and window of the one document
    of_doc = cut.groupBy("block", "row").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces")
    )
    path = _default(path)
    schema = (
        "doc_id long, source string, start long, length long, ids_crc32 long,"
        " doc_tokens long, sequence_id long, offset long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _encoder(path).dtype
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                lists = part.column(4)
                counts = np.asarray(lists.value_lengths())
                flat = lists.flatten()
                start, length, sequence, offset = (flat.field(k) for k in range(4))
                owner = pa.array(np.repeat(np.arange(len(counts)), counts))
                crcs, k = np.empty(len(flat), np.int64), 0
                begins, lengths = start.to_numpy(), length.to_numpy()
                for data, count in zip(part.column(3), counts, strict=True):
                    whole = memoryview(np.frombuffer(data.as_buffer(), dtype).astype("<u4").tobytes())
                    for k in range(k, k + count):
                        crcs[k] = zlib.crc32(whole[4 * begins[k] : 4 * (begins[k] + lengths[k])])
                    k += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(owner),
                        part.column(1).take(owner),
                        start,
                        length,
                        pa.array(crcs),
                        part.column(2).take(owner),
                        sequence,
                        offset,
                    ],
                    ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    source = F.when(F.col("queue") == "", None).otherwise(F.expr("substr(queue, 2)")).alias("source")
    whole = ids.select("block", "row", "doc_id", source, "n", "ids").join(of_doc, ["block", "row"])
    return whole.select("doc_id", "source", "n", "ids", "pieces").mapInArrow(run, schema)


def mixture(pieces: DataFrame) -> DataFrame:
    """(sequence_id, source, n_tokens): what each sequence holds of each source."""
    return pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n_tokens"))
