"""Duplicate substrings by sparse suffix sorting (deep-shallow).

Every byte that lies in a string of ``LENGTH`` bytes which also starts elsewhere, in any
document, is found and removed. Not all suffixes are sorted, only those at anchors: positions
whose hash is smallest in some window, so that equal strings of LENGTH bytes hold an
anchor at the same place. An anchor's key is the GRAM bytes at it, its context the
bytes that such a string around it can reach: LENGTH - GRAM to the left, LENGTH to the right.

1. Anchors with equal contexts settle each other without a look at the bytes.
2. Of each different context of a key one anchor is sorted, by its right side and by its left
   side: multikey quicksort on eight bytes at a time down to ``SHALLOW`` bytes, then blind
   tries for the groups that still agree. Both orders come with the lengths of common
   prefixes.
3. A string with o bytes to the left of the anchor occurs twice if two anchors agree on
   o bytes to the left and LENGTH - o to the right: if they fall into one run of both orders.

All found strings around one anchor contain it, so they cover one interval. The intervals
of a document are put together, and its bytes without them are hashed or returned.
A key with more than ``MOST`` contexts is dealt to several tasks: strings with lo to hi bytes to the
left of the anchor share their inner LENGTH - (hi - lo) bytes, so that the range of o is halved,
each half gets the longer inner string as its key, and halves that meet no other context are
dropped. Keys that are still too large are halved again, down to a single o, where equal keys
are equal strings and nothing is left to sort.

Anchors are counted with partial sums, and joined with the written counts, so that a key or context
that holds a large part of all rows needn't meet in one task.

Defined results: a null or empty text has no bytes; texts shorter than LENGTH lose nothing.
Rows that repeat a document are two places: all of it goes if it has LENGTH bytes. Rows are
told apart by doc_id and text, so null and repeated ids are fine. Matches never cross
documents. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH, GRAM = 400, 128
#: Bytes whose hash chooses anchors.
PICK = 16
#: Depth of the multikey quicksort.
SHALLOW = 64
#: Contexts of one key that one task sorts, and contexts sorted together.
MOST, TOGETHER = 50_000, 20_000
#: Windows whose anchors are chosen at once.
PIECE = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(x: np.ndarray, n: int, offset: int) -> np.ndarray:
    """The eight bytes at each of n positions as one number (the strided view overlaps)."""
    return np.ndarray((n,), "<u8", x, offset, (1,)).astype(np.uint64)


def _pick_hashes(x: np.ndarray) -> np.ndarray:
    n = len(x) - PICK + 1
    h = (_words(x, n, 0) * _A) ^ (_words(x, n, 8) * _B)
    h = (h ^ (h >> np.uint64(29))) * _A
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sliding(x: np.ndarray, width: int, what: np.ufunc, fill: int) -> np.ndarray:
    """``what`` over x[i : i + width] for each i, from running values to both sides of block ends."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    y = np.full(blocks * width, fill, x.dtype)
    y[: len(x)] = x
    y = y.reshape(blocks, width)
    ahead = what.accumulate(y, axis=1).ravel()
    back = what.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return what(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(x: np.ndarray, ends: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Anchor positions in a buffer of documents that end at ``ends``.

    Windows that cross a document's end choose nothing.
    """
    windows = len(x) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64)
    width = length - gram + 1  # places for an anchor in one string
    h = _pick_hashes(x)[: windows + width - 1]
    low = _sliding(h, width, np.minimum, 0xFFFFFFFF)
    # documents are few in a buffer: blank the windows that reach over each end
    for end in ends[:-1]:
        low[max(0, end - length + 1) : end] = 0
    # an anchor is the smallest of some window around it
    padded = np.concatenate([np.zeros(width - 1, np.uint32), low, np.zeros(width - 1, np.uint32)])
    high = _sliding(padded, width, np.maximum, 0)
    return np.flatnonzero(high[: len(h)] == h)


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Documents laid end to end: their numbers, ends, bytes. Too short ones are left out."""
    which, ends, parts, n = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            which.append(i)
            n += len(t)
            ends.append(n)
            parts.append(t)
            if n >= PIECE:
                yield which, ends, b"".join(parts)
                which, ends, parts, n = [], [], [], 0
    if which:
        yield which, ends, b"".join(parts)


def _all_anchors(x: np.ndarray, ends: np.ndarray, length: int, gram: int) -> np.ndarray:
    """``anchors`` over a long buffer, a piece of windows at a time."""
    if len(x) <= 4 * PIECE:
        return anchors(x, ends, length, gram)
    found = []
    for a in range(0, len(x) - length + 1, 2 * PIECE):
        b = min(len(x), a + 2 * PIECE + length - 1)
        inside = ends[(ends > a) & (ends < b)] - a
        found.append(a + anchors(x[a:b], np.append(inside, b - a), length, gram))
    return np.unique(np.concatenate(found))


ANCHOR_SCHEMA = "doc_id long, t8 long, pos int, ra int, key long, c1 long, c2 long"


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per anchor: where it is, bytes to its right (at most ``length``), key, context digest."""
    import xxhash

    left = length - gram
    names = [x.split()[0] for x in ANCHOR_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_digest
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids, t8 = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = [(t or "").encode() for t in part.column(2).to_pylist()]
                for which, ends, data in _buffers(texts, length):
                    stops = np.array(ends)
                    at = _all_anchors(np.frombuffer(data, np.uint8), stops, length, gram)
                    doc = np.searchsorted(stops, at, side="right")
                    starts = np.concatenate(([0], stops[:-1]))
                    lo, hi = np.maximum(starts[doc], at - left), np.minimum(stops[doc], at + length)
                    view = memoryview(data)
                    # the lengths of both sides belong to the context: a document's end agrees with nothing
                    where = zip(lo.tolist(), at.tolist(), hi.tolist(), strict=True)
                    rows = [
                        (short(view[p : p + gram]), digest(view[a:b], seed=(p - a) * 4096 + b - p)) for a, p, b in where
                    ]
                    keys = np.frombuffer(b"".join(k for k, _ in rows), "<i8")
                    marks = np.frombuffer(b"".join(c for _, c in rows), "<i8").reshape(-1, 2)
                    of = [which[d] for d in doc.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[d] for d in of], pa.int64()),
                            pa.array([t8[d] for d in of], pa.int64()),
                            pa.array((at - starts[doc]).astype(np.int32)),
                            pa.array((hi - at).astype(np.int32)),
                            pa.array(keys),
                            pa.array(marks[:, 0].copy()),
                            pa.array(marks[:, 1].copy()),
                        ],
                        names,
                    )

    return _named(docs).mapInArrow(run, ANCHOR_SCHEMA)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, t8 (hash of the text, tells rows of one id apart), text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t8"), "text")


# -- sorting ---------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree on ``at`` bytes."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    low, high = at, n  # they agree on low, not on high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A trie that stores only branching bytes and depths.

    To insert a string, a leaf is reached by the branching bytes alone, one comparison with
    that leaf's string gives the true depth of agreement, and the string branches off there.
    A string's end sorts before any byte.
    """

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list | int = first  # inner node: [depth, {byte: child}]; leaf: number of a string
        self.same: dict[int, list[int]] = {first: [first]}

    def insert(self, i: int, agreed: int) -> None:
        s = self.strings[i]
        node, path = self.root, []
        while isinstance(node, list):
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c)
            if node is None:
                node = path[-1]
                while isinstance(node, list):
                    node = next(iter(node[1].values()))
        t = self.strings[node]
        depth = common_prefix(s, t, agreed)
        if depth == len(s) == len(t):
            self.same[node].append(i)
            return
        self.same[i] = [i]
        # the lowest node on the path at or above the depth, and what hangs below it there
        above = None
        for step in path:
            if step[0] <= depth:
                above = step
            else:
                break
        mine = s[depth] if depth < len(s) else -1
        if above is not None and above[0] == depth:
            above[1][mine] = i
            return
        if above is None:
            below, put = self.root, None
        else:
            c = s[above[0]] if above[0] < len(s) else -1
            below, put = above[1][c], c
        theirs = t[depth] if depth < len(t) else -1
        branch = [depth, {theirs: below, mine: i}]
        if put is None:
            self.root = branch
        else:
            above[1][put] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and with each the common prefix with the one before it (first: 0)."""
        order, prefix = [], []
        todo: list[tuple[list | int, int]] = [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            if isinstance(node, list):
                children = sorted(node[1].items(), reverse=True)
                todo += [(child, node[0]) for _, child in children[:-1]]
                todo.append((children[-1][1], shared))
            else:
                for k, i in enumerate(self.same[node]):
                    order.append(i)
                    prefix.append(len(self.strings[i]) if k else shared)
        return order, prefix


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group and content, and common prefixes of neighbours.

    The prefix of a string whose predecessor is of another group is -1.
    """
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    head = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    block = np.frombuffer(head, ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    # shallow: split by eight bytes at a time; only ties go on to the next eight
    order = np.argsort(groups, kind="stable")
    start = np.append(True, groups[order][1:] != groups[order][:-1])
    new_group = start.copy()
    for k in range(SHALLOW // 8):
        ids = np.cumsum(start)
        tied = np.flatnonzero(np.bincount(ids)[ids] > 1)
        if not len(tied):
            break
        part = order[tied]
        by = np.lexsort((block[part, k], ids[tied]))
        order[tied] = part[by]
        v = block[order[tied], k]
        start[tied[1:]] |= (v[1:] != v[:-1])
    # deep: blind tries for what still agrees; strings that end early are ordered there, too
    prefix = np.zeros(n, np.int64)
    edges = np.append(np.flatnonzero(start), n)
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        if b - a > 1:
            members = order[a:b].tolist()
            trie = BlindTrie(strings, members[0])
            agreed = min(SHALLOW, int(lengths[members].min()))
            for i in members[1:]:
                trie.insert(i, agreed)
            found, shared = trie.ordered()
            order[a:b] = found
            prefix[a + 1 : b] = shared[1:]
    for e in edges[1:-1].tolist():
        prefix[e] = -1 if new_group[e] else common_prefix(strings[order[e - 1]], strings[order[e]])
    prefix[0] = -1
    return order, prefix


def cover(
    keys: np.ndarray, left: list[bytes], right: list[bytes], length: int, least: np.ndarray, most: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per context the smallest and largest o for which its string with o bytes to the left of the
    anchor occurs in another context of the key; (length, -1) if there is none.

    ``left`` is read from the anchor outwards; o goes from ``least`` to ``most`` of the context's key.
    """
    n = len(keys)
    r_order, r_prefix = deep_shallow(right, keys)
    l_order, l_prefix = deep_shallow(left, keys)
    low, high = np.full(n, length), np.full(n, -1)
    r_run, l_run = np.empty(n, np.int64), np.empty(n, np.int64)
    l_len = np.fromiter(map(len, left), np.int64, n)
    r_len = np.fromiter(map(len, right), np.int64, n)
    for o in range(int(least.min()), int(most.max()) + 1):
        r_run[r_order] = np.cumsum(r_prefix < length - o)
        l_run[l_order] = np.cumsum(l_prefix < o)
        pair = r_run * (n + 1) + l_run
        by = np.argsort(pair, kind="stable")
        p = pair[by]
        same = p[1:] == p[:-1]
        twice = by[np.append(same, False) | np.append(False, same)]
        twice = twice[(l_len[twice] >= o) & (r_len[twice] >= length - o)]
        twice = twice[(least[twice] <= o) & (o <= most[twice])]
        low[twice] = np.minimum(low[twice], o)
        high[twice] = o
    return low, high


# -- Spark -----------------------------------------------------------------------------------

INTERVAL = "doc_id long, t8 long, a int, b int"
#: A context of a key: where its anchor is, the key, the range of o that the key stands for, whether all is
#: settled, how many contexts the key has, and the bytes: left part from the anchor outwards, right part.
CONTEXT = (
    "doc_id long, t8 long, pos int, key long, key2 long, least int, most int, settled boolean, n long, l binary, r binary"
)
CONTEXT_SCHEMA = pa.schema(
    [
        (x.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]])
        for x in CONTEXT.split(", ")
    ]
)


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, t8), where null ids are equal."""
    r = right.withColumnsRenamed({"doc_id": "__d", "t8": "__t"})
    same = left["doc_id"].eqNullSafe(r["__d"]) & left["t8"].eqNullSafe(r["__t"])
    return left.join(r, same, how).drop("__d", "__t")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(CONTEXT_SCHEMA)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, CONTEXT_SCHEMA, strict=True)], schema=CONTEXT_SCHEMA
    )


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The wanted contexts with their bytes."""
    fields = CONTEXT_SCHEMA.names[2:-2]
    per_doc = wanted.groupBy("doc_id", "t8").agg(F.collect_list(F.struct(*fields)).alias("at"))
    rows = _joined(_named(docs), per_doc, "inner").select("doc_id", "t8", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for doc, t8, text, at in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    data = text.encode()
                    for x in at:
                        p = x["pos"]
                        left, right = data[max(0, p - length + gram) : p][::-1], data[p : p + length]
                        out.append((doc, t8, *(x[f] for f in fields), left, right))
                yield _batch(out)

    return rows.mapInArrow(run, CONTEXT)


def _halved(contexts: DataFrame, length: int) -> DataFrame:
    """``contexts`` with each range of o in two halves, keyed by the bytes that all strings of a half share."""
    import xxhash

    names = CONTEXT_SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                out = []
                for x in batch.select(names).slice(i, 1024).to_pylist():
                    middle, left, right = (x["least"] + x["most"]) // 2, x["l"], x["r"]
                    for least, most in ((x["least"], middle), (middle + 1, x["most"])):
                        if least <= len(left) and length - most <= len(right):  # else no string of this half fits
                            shared = left[:least][::-1] + right[: length - most]
                            mark = xxhash.xxh3_128_digest(shared, seed=least * 4096 + most)
                            key, key2 = (int.from_bytes(mark[k : k + 8], "little", signed=True) for k in (0, 8))
                            new = {"key": key, "key2": key2, "least": least, "most": most, "n": 0}
                            out.append(tuple((x | new)[f] for f in names))
                yield _batch(out)

    return contexts.mapInArrow(run, CONTEXT)


def _sorted_cover(contexts: DataFrame, length: int) -> DataFrame:
    """Intervals from sorting, a task reading whole keys and sorting many keys together."""
    rows = contexts.repartition("key", "key2").sortWithinPartitions("key", "key2")
    names = ["doc_id", "t8", "a", "b"]

    def groups(table: pa.Table) -> np.ndarray:
        """Number of the key in each row."""
        k, k2 = table["key"].to_numpy(), table["key2"].to_numpy()
        return np.cumsum(np.append(False, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            pos, least, most = (table[n].to_numpy().astype(np.int64) for n in ("pos", "least", "most"))
            settled = table["settled"].to_numpy(zero_copy_only=False)
            low, high = cover(groups(table), table["l"].to_pylist(), table["r"].to_pylist(), length, least, most)
            found = (high >= 0) & ~settled
            take = table.filter(pa.array(found)).combine_chunks()
            a, b = (pos - high)[found], (pos - low + length)[found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(take["doc_id"].to_pylist(), pa.int64()),
                    pa.array(take["t8"].to_pylist(), pa.int64()),
                    pa.array(a.astype(np.int32)),
                    pa.array(b.astype(np.int32)),
                ],
                names,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= TOGETHER:
                table = pa.Table.from_batches(held)
                of = groups(table)
                whole = int(np.searchsorted(of, of[-1], side="left"))  # the last key may go on
                if whole:
                    yield work(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    count -= whole
        if count:
            yield work(pa.Table.from_batches(held))

    return rows.mapInArrow(run, INTERVAL)


def intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc_id, t8, a, b): byte intervals whose union is exactly what occurs elsewhere, too."""
    rows = written(anchor_rows(docs, length, gram), "anchors")
    # any anchor of a context stands for it: their bytes are equal, and so are their keys
    same, one = ["c1", "c2"], [F.first(c).alias(c) for c in ("doc_id", "t8", "pos", "key")]
    groups = written(rows.groupBy(same).agg(F.count("*").alias("n"), *one), "contexts")
    # equal contexts: every string around the anchor that fits into the document
    far = F.least(F.lit(length - gram), F.col("pos"))
    near = F.greatest(F.lit(0), length - F.col("ra"))
    around = rows.select(*same, "doc_id", "t8", "pos", "ra").where(near <= far)
    equal = around.join(groups.where("n > 1").select(same), same)
    found = equal.select("doc_id", "t8", (F.col("pos") - far).alias("a"), (F.col("pos") - near + length).alias("b"))
    wanted = groups.select(
        "doc_id", "t8", "pos", "key", F.lit(0).cast("long").alias("key2"), F.lit(0).alias("least"),
        F.lit(length - gram).alias("most"), (F.col("n") > 1).alias("settled"),
    )
    wanted = written(_of_shared_keys(wanted), "wanted")
    contexts = _contexts(docs, wanted, length, gram)
    large, single, at = F.col("n") > most, F.col("least") == F.col("most"), F.col("pos") - F.col("least")
    if wanted.where(large).isEmpty():
        return found.unionByName(_sorted_cover(contexts, length))
    contexts = written(contexts, "contexts-with-bytes")
    found = found.unionByName(_sorted_cover(contexts.where(~large), length))
    while not contexts.where(large & ~single).isEmpty():
        halves = written(_halved(contexts.where(large & ~single), length), "halves")
        contexts = written(_of_shared_keys(halves.drop("n")), "contexts-halved")
        found = found.unionByName(_sorted_cover(contexts.where(~large & ~single), length))
        # a single o: the key is the string
        alone = contexts.where(single & ~F.col("settled"))
        found = found.unionByName(alone.select("doc_id", "t8", at.alias("a"), (at + length).alias("b")))
    return found


def _of_shared_keys(rows: DataFrame) -> DataFrame:
    """Rows whose key others have, too, with the number of rows of the key."""
    keys = ["key", "key2"]
    per_key = written(rows.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1"), "keys")
    return rows.join(per_key, keys)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals as maximal runs; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, bytes_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; ``bytes_too`` adds the kept bytes."""
    found = intervals(docs, length, gram, most)
    per_doc = found.groupBy("doc_id", "t8").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    rows = _joined(_named(docs), per_doc, "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    if bytes_too:
        schema += ", kept binary"
        kinds.append(pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode()
                    spans = merged([(x["a"], x["b"]) for x in runs or ()])
                    kept = remove(data, spans)
                    row = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept) if bytes_too else row)
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    return rows.mapInArrow(run, schema)
