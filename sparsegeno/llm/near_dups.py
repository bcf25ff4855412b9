"""HyperMinHash near-duplicates with exact confirmation.

A document is the set of its distinct four-word shingles. Its sketch has ``REGISTERS``
buckets; a bucket keeps the smallest hash under its own permutation in compressed form:
the count of leading zeros (5 bits) and the ``MANTISSA`` bits after the first one. Bands of
``ROWS`` registers are the join keys. Candidate pairs pass if their Jaccard similarity,
estimated from equal registers and corrected for chance collisions, is not far below the
threshold; each survivor is confirmed on the full sets.

Equal sets are one node. Links are found without all pairs of a bucket:

1. every node is compared with one node, the smallest hub (first node) of its buckets; links
   give components, which settles large groups of near copies; ``HUB_ROUNDS`` times, the later ones with
   hubs in other components that weren't tried yet;
2. buckets that still hold two or more components are searched for links across
   components, in blocks of bounded size. A pair is looked at in the first band that it
   shares; if the estimate lets it pass and the task hasn't joined its components yet, it is
   confirmed on the spot. Only links that join components leave the task, so there are
   never more than nodes.

A pair at the threshold misses all bands with probability (1 - 0.8^5)^40 = 1.2e-7, and
the estimate's slack is six standard deviations.

Defined results: documents without words have an empty set and are linked with nothing;
their component is their own id. A null doc_id is ignored in minima: its component is the
smallest id of its group, or null. Rows that repeat a doc_id are judged each by its own text, and each
is kept if its id is the smallest of its component. Extra columns are ignored (``near_duplicates``)
or carried along (``keep``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, written
from .connected import components

SHINGLE = 4
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 11
SLACK = 6 * math.sqrt(0.8 * 0.2 / REGISTERS)
HUB_ROUNDS = 1
#: Nodes and shingles in a block of the search across components; members of a hub in one task.
BLOCK, BLOCK_SHINGLES, MEMBERS = 2048, 4_000_000, 5000
#: Bytes that are hashed at once; a longer word makes a longer piece.
PIECE = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(2024)
_XOR = _rng.integers(0, 1 << 32, (REGISTERS, 1), np.uint32)
_MUL = _rng.integers(0, 1 << 31, (REGISTERS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


#: The shares of bytes at the first places of a word.
_NEAR = _mixed(_mixed(np.arange(1, 1 + 64 * 256, dtype=np.uint64)) + _BASE)


def _shares(place: np.ndarray) -> np.ndarray:
    """A random-looking number for each pair of a place in a word and the byte there, given as 256 * place + byte."""
    out = _NEAR[np.minimum(place, len(_NEAR) - 1)]
    far = np.flatnonzero(place >= len(_NEAR))
    if len(far):
        out[far] = _mixed(_mixed(place[far].astype(np.uint64) + np.uint64(1)) + _BASE)
    return out


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        cuts = [c for c in (data.rfind(w, at, at + PIECE) for w in (b" ", b"\n", b"\t")) if c > at]
        end = max(cuts) if cuts else min((c for c in (data.find(w, at + PIECE) for w in (b" ", b"\n")) if c > 0), default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z lowered: sums of a share for each byte and its place.

    Not a polynomial in the bytes, for which words that collide under every base can be written down.
    """
    found = []
    for piece in _pieces((text or "").encode().lower()):
        x = np.frombuffer(piece, np.uint8)
        word = ~((x == 32) | ((x >= 9) & (x <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        length = edge[1::2] - edge[::2]
        if len(length):
            begin = np.cumsum(length) - length
            place = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
            total = np.add.reduceat(_shares(place * 256 + x[word]), begin)
            found.append(_mixed(total ^ (length.astype(np.uint64) * _MIX)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The document's set: sorted distinct hashes of its four-word shingles."""
    h = word_hashes(text)
    k = min(SHINGLE, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _BASE + h[i : i + n])
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of each bucket's permutation."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = (x[None, i : i + 2048] ^ _XOR) * _MUL
        np.minimum(best, h.min(axis=1), out=best)
    return best


def compress(best: np.ndarray) -> np.ndarray:
    """Registers: leading zeros, then the bits after the first one."""
    part, exponent = np.frexp(best.astype(np.float64))
    zeros = np.clip(32 - exponent, 0, 31)
    bits = np.where(best > 0, ((part - 0.5) * (1 << (MANTISSA + 1))).astype(np.int64), 0)
    return (zeros.astype(np.int64) << MANTISSA | bits).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = _mixed(key * _BASE + parts[:, :, i])
    return key.view(np.int64)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets of sizes a and b are equal.

    With z leading zeros a register's cell is 2^-(z + 1 + MANTISSA) wide, and the minima
    of the sets have densities a e^(-ax) and b e^(-bx).
    """
    z = np.arange(32.0)
    s = (a + b)[..., None]
    inside = np.exp(-s * 2.0 ** -(z + 1)) - np.exp(-s * 2.0**-z)
    return (a * b / (a + b)) * (2.0 ** -(z + 1 + MANTISSA) * inside).sum(axis=-1)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    by_chance = chance(a, b)
    return (equal / REGISTERS - by_chance) / (1 - by_chance)


def may_link(equal, a, b) -> np.ndarray:
    """Whether a pair with these equal registers and set sizes has to be confirmed."""
    sizes = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
    return sizes & (estimate(equal, a.astype(float), b.astype(float)) >= PERCENT / 100 - SLACK)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (MD5), n_shingles, node (id of the set, null if empty), registers, bands."""
    import xxhash

    schema = "doc_id long, text_id string, n_shingles long, node string, registers binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [shingles(x.as_py()) for x in part.column(2)]
                low = compress(np.stack([minima(s) for s in sets]))
                nodes = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                keys = band_keys(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(nodes, pa.string()),
                        pa.array([r.tobytes() if n else None for r, n in zip(low, nodes, strict=True)], pa.binary()),
                        pa.array([k if n else None for k, n in zip(keys, nodes, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_id", "n_shingles", "node", "registers", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("text_id"), "text").mapInArrow(run, schema)


def _short(node: str = "node"):
    """A long for a node in the wide band table; a clash only adds a candidate."""
    return F.xxhash64(node).alias("nid")


def _sets(sk: DataFrame) -> DataFrame:
    """One row per node, however many documents hold it: nid, node, doc (smallest id), and its sketch."""
    any_text = F.min(F.struct("text_id", F.col("n_shingles").alias("n"), "registers", "bands")).alias("r")
    rows = sk.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc"), any_text
    )
    return written(rows.select(_short(), "node", "doc", "r.*"), "sets")


def _shared_buckets(sets: DataFrame) -> DataFrame:
    """(bucket, band, nid, hub) of the buckets with two or more different nodes."""
    spread = sets.select(F.posexplode("bands").alias("band", "bucket"), "nid")
    hubs = spread.groupBy("bucket").agg(F.min("nid").alias("hub"), F.max("nid").alias("last"))
    hubs = written(hubs.where("hub != last").select("bucket", "hub"), "hubs")
    return written(spread.join(hubs, "bucket").distinct(), "buckets")


def _by_nid(sets: DataFrame, used: DataFrame) -> DataFrame:
    """One row per node that ``used`` (nid) names: nid, node, n, registers, text_id."""
    rows = sets.select("nid", "node", "n", "registers", "text_id")
    return written(rows.join(used.distinct(), "nid", "left_semi"), "nodes")


def _proposals(buckets: DataFrame, nodes: DataFrame, labels: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """(hub, nid): for each node the smallest hub of its buckets in another component, not tried yet.

    One pair per node, however many buckets it shares.
    """
    rows = buckets.where("nid != hub").select("hub", "nid")
    if labels is not None:
        known = nodes.join(labels, "node").select("nid", "label")
        own = known.groupBy("nid").agg(F.min("label").alias("own"))
        rows = rows.distinct().join(own, "nid", "left")
        rows = rows.join(own.withColumnsRenamed({"nid": "hub", "own": "theirs"}), "hub", "left")
        rows = rows.where(F.col("own").isNull() | F.col("theirs").isNull() | (F.col("own") != F.col("theirs")))
        rows = rows.select("hub", "nid").join(tried, ["hub", "nid"], "left_anti")
    return cut(rows.groupBy("nid").agg(F.min("hub").alias("hub")).select("hub", "nid"))


def _hub_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (hub, nid) those (a, b), hub first, whose sketches pass the estimate."""
    a = nodes.select(
        F.col("nid").alias("hub"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")
    )
    b = nodes.select("nid", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    wide = pairs.join(a, "hub").join(b, "nid").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ra, rb = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5)
            )
            good = may_link((ra == rb).sum(axis=1), na, nb)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return wide.mapInArrow(run, "a string, b string")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = _common(a, b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


class _Block:
    """Nodes of one bucket that meet in one task."""

    def __init__(self):
        self.own, self.node, self.label, self.registers, self.sets = [], [], [], [], []

    def links(self, i: int, j: int, band: int) -> Iterator[tuple[str, str]]:
        """Links between blocks i and j that join components which nothing here has joined before."""
        own, n = np.array(self.own), np.array([len(s) for s in self.sets])
        part = np.unique(self.label, return_inverse=True)[1]
        reg = np.frombuffer(b"".join(self.registers), np.uint16).reshape(-1, REGISTERS)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for k in left:
            others = right[right > k] if i == j else right
            others = others[part[others] != part[k]]
            if not len(others):
                continue
            equal = reg[others] == reg[k]
            good = may_link(equal.sum(axis=1), n[others], np.broadcast_to(n[k], len(others)))
            others, equal = others[good], equal[good]
            first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            others, equal = others[first], equal[first]
            for o in others[np.argsort(-equal.sum(axis=1), kind="stable")]:
                if part[o] != part[k] and _linked(self.sets[k], self.sets[o]):
                    part[part == part[o]] = part[k]
                    yield self.node[k], self.node[o]


def _cross_links(docs: DataFrame, buckets: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) across components inside one bucket; enough of them to join all that have any."""
    known = nodes.join(labels, "node", "left").select("nid", "node", "n", F.coalesce("label", "node").alias("label"))
    known = cut(known)
    named = buckets.select("bucket", "nid").join(known, "nid")
    mixed = named.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), F.sum("n").alias("total")
    )
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.where("lo != hi").select("bucket", blocks.alias("blocks"))
    rows = cut(buckets.select("band", "bucket", "nid").join(mixed, "bucket"))
    used = nodes.join(rows.select("nid").distinct(), "nid", "left_semi")
    texts = _texts(docs, used, used.select(F.col("node").alias("a"), F.col("node").alias("b")))
    full = known.join(used.select("node", "registers"), "node").join(texts, "node")
    full = full.select("nid", "node", "label", "registers", "text")
    rows = rows.join(full, "nid")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    # a block meets every block once: block pairs (least, greatest)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "band",
        "own",
        "node",
        "label",
        "registers",
        "text",
    )
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, found = None, _Block(), []

        def close() -> None:
            if key is not None and len(block.own) > 1:
                found.extend(block.links(*key[1:]))

        def flush() -> pa.RecordBatch:
            out = [pa.array([x[c] for x in found], pa.string()) for c in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(out, ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["bucket"], row["i"], row["j"], row["band"])
                if here != key:
                    close()
                    key, block = here, _Block()
                for name in ("own", "node", "label", "registers"):
                    getattr(block, name).append(row[name])
                block.sets.append(shingles(row["text"]))
            yield flush()
        close()
        yield flush()

    return rows.mapInArrow(run, "a string, b string").distinct()


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text): one text for each node in ``pairs``."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = cut(nodes.join(used, "node", "left_semi").select("node", "text_id"))
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.where("text is not null").select(F.md5("text").alias("text_id"), "text")
    found = texts.join(F.broadcast(ids) if few else ids, "text_id")
    # copies of one text are many rows; keep one for each node before anything else moves
    return found.groupBy("node").agg(F.first("text").alias("text"))


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets.

    Pairs are grouped by ``a``. A task reads a's text, then streams the texts of its
    partners; an ``a`` with many partners is copied to as many tasks as it needs.
    """
    pairs = cut(pairs)
    texts = _texts(docs, nodes, pairs)
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("tasks"))
    hub = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("part"), F.col("a").alias("node"))
    member = pairs.join(spread, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("part"), F.col("b").alias("node")
    )
    rows = hub.unionByName(member).join(texts, "node").select("a", "task", "part", "node", "text")
    rows = rows.repartition("a", "task").sortWithinPartitions("a", "task", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            links = []
            for a, part, node, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                found = shingles(text)
                if part == 0:
                    hub, own = a, found
                elif hub == a:
                    if _linked(own, found):
                        links.append((a, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.string()), pa.array([y for _, y in links], pa.string())], ["a", "b"]
            )

    return rows.mapInArrow(run, "a string, b string")


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of nodes after ``links`` have joined components; untouched single nodes stay absent."""
    if labels is None:
        return cut(components(links))
    ends = labels.withColumnsRenamed({"node": "end", "label": "__label"})
    for side in ("a", "b"):
        links = links.join(ends.withColumnRenamed("end", side), side, "left")
        links = links.withColumn(side, F.coalesce("__label", side)).drop("__label")
    outer = components(links)
    top = outer.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return cut(old.unionByName(outer.join(labels.select("node"), "node", "left_anti")))


def _components(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component_id) of every set; component_id is the smallest doc_id reachable."""
    buckets = _shared_buckets(sets)
    nodes = _by_nid(sets, buckets.select("nid"))
    labels, tried = None, None
    for _ in range(HUB_ROUNDS):
        pairs = _proposals(buckets, nodes, labels, tried)
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = _merge(labels, confirm(_hub_pairs(pairs, nodes), docs, nodes))
    if labels is not None:
        rest = cut(_cross_links(docs, buckets, nodes, labels))
        if not rest.isEmpty():
            labels = _merge(labels, rest)
    own = sets.select("node", "doc")
    if labels is None:
        return own.withColumnRenamed("doc", "component_id")
    own = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = written(own.groupBy("label").agg(F.min("doc").alias("component_id")), "components")
    return own.select("node", "label").join(least, "label").select("node", "component_id")


def _judged(docs: DataFrame) -> DataFrame:
    sk = written(sketches(docs), "sketches")
    found = written(_components(docs, _sets(sk)), "found")
    rows = sk.select("doc_id", "text_id", "n_shingles", "node")
    # empty sets, which may be many, aren't shuffled
    empty = rows.where("node is null").withColumn("component_id", F.col("doc_id"))
    rows = rows.join(found, "node").unionByName(empty)
    return rows.select(
        "doc_id", "text_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return _judged(docs).drop("text_id")


def keep(docs: DataFrame) -> DataFrame:
    """The documents without those that have a near copy with a smaller id; all columns unchanged."""
    gone = _judged(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.md5(docs["text"]) == F.col("__text"))
    return docs.join(gone, same, "left_anti")
