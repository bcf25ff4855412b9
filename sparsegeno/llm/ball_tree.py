"""Ranked lexical search as an exact inner-product search in ball trees of sparse vectors.

A document is the vector of its terms' integer saturations, a query that of its terms' integer weights; the
score is their inner product. Only terms of the queries can score, so a document keeps those alone. Each task
builds one tree per block of documents: nodes are halved between two far documents, and hold the centroid and the
radius of their documents. For every query a node's bound is the centroid's score plus the radius times the length of the query's part
that lies on terms of the node; sums of doubles are rounded up by far more than their error. Nodes are opened in the order
of their bounds until none can reach the tenth best score; leaves are scored exactly in 64-bit integers.

The search runs twice. First every block opens a few leaves only, which gives each query a score that ten documents
reach at least; then every block is searched with that score as the least, so that most blocks of a large table end at
their root. What meets afterwards is ten rows per block and query.

Queries are taken in groups of bounded size, each with its own pass, so that what tasks get is bounded however many there are.

Defined results: null and empty texts, and texts without a term, are no documents and match nothing; queries without
a term give no rows. Equal scores are ordered by doc_id, null last. Repeated documents are documents of their own; repeated
queries are queries of their own. No documents or no queries give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path

#: Documents of a block at most, and terms of its documents at most; documents of a leaf.
BLOCK, BLOCK_TERMS, LEAF = 8192, 2_000_000, 64
#: Bytes of the texts of the queries that are searched for together.
GROUP_BYTES = 4_000_000
#: Leaves that a block opens for a query in the first search.
PROBE = 2
#: A letter or digit is kept, A to Z in lower case; every other ASCII character ends a term.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERMS).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of documents with a term, as a table of the shared folder; term and tf are arrays over query terms."""
    schema = "doc_id long, n long, term array<int>, tf array<int>"
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of one group of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                keep, sizes, which, often = [], [], [], []
                for row, text in enumerate(part.column(1)):
                    found = terms(text.as_py())
                    if found:
                        ids = np.array([x for x in map(find, found) if x is not None], np.int32)
                        ids, tf = np.unique(ids, return_counts=True)
                        keep.append(row)
                        sizes.append(len(found))
                        which.append(ids)
                        often.append(tf.astype(np.int32))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in which]))).astype(np.int32))
                none = [np.zeros(0, np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep, pa.int64())),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(which + none))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(often + none))),
                    ],
                    ["doc_id", "n", "term", "tf"],
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    path = new_path(docs.sparkSession, "search-terms")
    read.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(read.schema).parquet(path)


def frequencies(counts: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each query term is: sums within tasks, then one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        which = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(df[which])], ["t", "df"])

    df = np.zeros(n_terms, np.int64)
    for t, n in counts.select("term").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df")).collect():
        df[t] = n
    return df


class Vectors:
    """Sparse vectors: terms and values of all, row after row; no row is empty."""

    def __init__(self, begin: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.begin, self.term, self.value = begin, term, value

    def rows(self, which: np.ndarray) -> Vectors:
        length = self.begin[which + 1] - self.begin[which]
        begin = np.concatenate(([0], np.cumsum(length)))
        take = np.repeat(self.begin[which] - begin[:-1], length) + np.arange(begin[-1])
        return Vectors(begin, self.term[take], self.value[take])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of each row with a dense vector, in the type of both."""
        return np.add.reduceat(self.value * dense[self.term], self.begin[:-1])


class Node:
    __slots__ = ("term", "centre", "radius", "leaf", "sides")


class Tree:
    """A ball tree over integer vectors."""

    def __init__(self, vectors: Vectors, n_terms: int, leaf: int = LEAF):
        self.n_terms, self.leaf = n_terms, leaf
        self.floats = Vectors(vectors.begin, vectors.term, vectors.value.astype(np.float64))
        self.squares = np.add.reduceat(self.floats.value**2, vectors.begin[:-1])
        self.order: list[np.ndarray] = []
        self.root = self.build(np.arange(len(vectors.begin) - 1))
        self.order = np.concatenate(self.order)
        self.all = vectors.rows(self.order)  # the documents of a leaf side by side

    def distances(self, own: Vectors, squares: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return squares - 2 * own.dot(dense) + dense @ dense

    def dense(self, own: Vectors, row: int) -> np.ndarray:
        out, part = np.zeros(self.n_terms), slice(own.begin[row], own.begin[row + 1])
        out[own.term[part]] = own.value[part]
        return out

    def build(self, rows: np.ndarray) -> Node:
        root, todo, done = None, [(rows, None)], 0
        while todo:
            rows, parent = todo.pop()
            own, squares = self.floats.rows(rows), self.squares[rows]
            node = Node()
            centre = np.bincount(own.term, own.value, self.n_terms) / len(rows)
            away = self.distances(own, squares, centre)
            # rounded up: the error of these sums is far below a part in 2^30 of their largest term
            slack = (squares.max() + centre @ centre) * 2.0**-30
            node.radius = math.sqrt(max(0.0, away.max()) + slack) * (1 + 2.0**-30)
            node.term = np.flatnonzero(centre)
            node.centre = centre[node.term]
            node.sides = []
            if len(rows) > self.leaf and away.max() > slack:
                far = self.dense(own, int(away.argmax()))
                one = self.distances(own, squares, far)
                other = self.distances(own, squares, self.dense(own, int(one.argmax())))
                order = np.argsort(one - other, kind="stable")
                half = len(rows) // 2
                todo += [(np.sort(rows[order[:half]]), node), (np.sort(rows[order[half:]]), node)]
            else:
                self.order.append(rows)
                node.leaf = done, done + len(rows)
                done += len(rows)
            if parent is None:
                root = node
            else:
                parent.sides.append(node)
        return root

    def bound(self, node: Node, which: np.ndarray, part: np.ndarray) -> float:
        """No document of the node scores more; only the query's part on terms of the node can leave the centroid."""
        at = np.searchsorted(node.term, which)
        at[at == len(node.term)] = 0
        there = node.term[at] == which
        part = part[there]
        return (part @ node.centre[at[there]] + math.sqrt(part @ part) * node.radius) * (1 + 2.0**-30) + 1

    def search(
        self, which: np.ndarray, weight: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int, least: int, leaves: float = math.inf
    ) -> tuple[list, int]:
        """The k best (score, -doc_id) of at least ``least`` and above 0, and how many documents were scored.

        ``query`` is a dense vector that holds ``weight`` at the terms ``which``.
        """
        part = weight.astype(np.float64)
        best: list[tuple[int, int]] = []  # a heap, its worst first
        least, scored, nth = max(1, least), 0, 0
        queue = [(-self.bound(self.root, which, part), 0, self.root)]
        while queue and leaves > 0:
            bound, _, node = heapq.heappop(queue)
            if -bound < least:
                break
            if node.sides:
                for side in node.sides:
                    reach = self.bound(side, which, part)
                    if reach >= least:
                        nth += 1
                        heapq.heappush(queue, (-reach, nth, side))
                continue
            leaves -= 1
            lo, hi = node.leaf
            scored += hi - lo
            begin = self.all.begin[lo : hi + 1]
            held = slice(begin[0], begin[-1])
            scores = np.add.reduceat(self.all.value[held] * query[self.all.term[held]], begin[:-1] - begin[0])
            for i in np.flatnonzero(scores >= least).tolist():
                found = int(scores[i]), -int(ids[self.order[lo + i]])
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                least = max(least, best[0][0])
        return sorted(best, reverse=True), scored


def saturation(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The integer weight of a term that is ``tf`` times in a document of ``n`` terms."""
    if docs * int(n.max(initial=0)) < 2**63 // 75:
        m = 25 + (75 * docs * n) // length
    else:
        m = np.array([25 + 75 * docs * int(x) // length for x in n])
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


#: Stands for a null doc_id: after all others.
LAST = 2**63 - 1


def _search(counts: DataFrame, queries, n_terms: int, k: int, docs: int, length: int, least, probe: float, leaf: int, block: int):
    """(q, doc_id, score, scored) of the best of each block; ``least`` is a score per query that k documents reach."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Vectors]]:
        held, rows, size = [], 0, 0

        def made():
            ids = np.concatenate([x[0] for x in held])
            n, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            term, tf = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]).astype(np.int64)
            value = saturation(tf, np.repeat(n, lengths), docs, length)
            return ids, Vectors(np.concatenate(([0], np.cumsum(lengths))), term, value)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(2)
                held.append(
                    (
                        part.column(0).fill_null(LAST).to_numpy(),
                        part.column(1).to_numpy(),
                        lists.value_lengths().to_numpy().astype(np.int64),
                        lists.flatten().to_numpy(),
                        part.column(3).flatten().to_numpy(),
                    )
                )
                rows, size = rows + part.num_rows, size + len(held[-1][3])
                if rows + 256 > block or size > BLOCK_TERMS:
                    yield made()
                    held, rows, size = [], 0, 0
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, floor = queries.value, least.value
        for ids, vectors in blocks(batches):
            tree = Tree(vectors, n_terms, leaf)
            query, out = np.zeros(n_terms, np.int64), []
            for q, (which, weight) in enumerate(known):
                query[which] = weight
                best, scored = tree.search(which, weight, query, ids, k, floor[q], probe)
                query[which] = 0
                out += [(q, -doc, score, scored if not i else 0) for i, (score, doc) in enumerate(best or [(0, -LAST)])]
            q, doc, score, scored = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (q, doc, score, scored)], ["q", "doc", "score", "scored"]
            )

    return counts.where(F.size("term") > 0).mapInArrow(run, "q long, doc long, score long, scored long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    return found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group(docs: DataFrame, items: list, k: int, leaf: int, block: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one group of items (item_id, terms)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in items for t in found}))}
    counts = counted(docs, vocabulary)
    n_docs, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(counts, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries = []
    for _, found in items:
        which, often = np.unique(np.array([vocabulary[t] for t in found], np.int32), return_counts=True)
        queries.append((which, often * weight[which]))
    share = spark.sparkContext.broadcast  # one group of queries, a number for each
    queries, floor = share(queries), [0] * len(items)
    options = (len(vocabulary), k, n_docs, length)
    for q, score in (
        _best(_search(counts, queries, *options, share(floor), PROBE, leaf, block), k).where(F.col("rank") == k).select("q", "score").collect()
    ):
        floor[q] = score
    found = _best(_search(counts, queries, *options, share(floor), math.inf, leaf, block), k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], "q long, item_id long")
    doc = F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")
    return found.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), doc, "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, leaf: int = LEAF, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    out, held, size = None, [], 0

    def add(group):
        found = _group(docs, group, k, leaf, block)
        return found if out is None else out.unionByName(found)

    for item, text in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        found = terms(text)
        if not found:
            continue
        if held and size + len(text) > group_bytes:
            out, held, size = add(held), [], 0
        held.append((item, found))
        size += len(text)
    if held:
        out = add(held)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
