"""Byte-level BPE by an Aho-Corasick automaton with backtracking.

The bytes of a piece are mapped to Latin-1 so that the automaton, which works on
characters, works on bytes. From the left the longest vocabulary entry is taken;
if it cannot stand beside the entry before it (the merges would have joined them
differently), the next shorter one is tried, and when none is left the entry before
is given up. Whether two entries can stand side by side depends on those two alone and
is memoised, and a position that led nowhere is never entered again, so the work is
linear in the text.

Defined results: null and empty texts have no tokens. Any Unicode text round-trips.
Equal texts have equal ids. Extra columns are ignored by ``encode`` and ``digests``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces up to this many characters are remembered, and one to two times this many of them per worker.
MEMO_CHARS, MEMO_PIECES = 40, 250_000
#: Pairs of entries whose compatibility is remembered per worker, likewise.
MEMO_PAIRS = 250_000


def read_ranks(path: str) -> bytes:
    """The rank file: one base64 entry and its rank per line; about 1 MB whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


class Memo(dict):
    """Results of ``make`` for the last ``most`` keys, and for those of the ``most`` before them.

    A key in steady use is carried over and never worked out again.
    """

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class PieceMemo(Memo):
    """Results for short pieces; long ones are worked out each time."""

    def __missing__(self, piece: str):
        return super().__missing__(piece) if len(piece) <= MEMO_CHARS else self.make(piece)


class Tokenizer:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import ahocorasick
        import regex

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {v: k for k, v in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        longest = 0
        for entry, rank in self.rank.items():
            self.automaton.add_word(entry.decode("latin-1"), rank)
            longest = max(longest, len(entry))
        self.automaton.make_automaton()
        self.longest = longest
        self.beside = Memo(self.can_follow, MEMO_PAIRS)
        self.shorter = Memo(self.next_shorter, len(self.token))
        self.digits = {r: str(r) for r in self.token}
        self.spelled = {self.digits[r]: entry for r, entry in self.token.items()}
        self.pieces = PieceMemo(self.piece, MEMO_PIECES)

    def merged(self, data: bytes) -> list[bytes]:
        """Merges of one short string in order of rank; only ever called on two entries side by side."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def can_follow(self, pair: tuple[int, int]) -> bool:
        x, y = self.token[pair[0]], self.token[pair[1]]
        return self.merged(x + y) == [x, y]

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of ``token``; -1: none."""
        text = self.token[token]
        found = (self.rank.get(text[:n]) for n in range(len(text) - 1, 0, -1))
        return next((r for r in found if r is not None), -1)

    def longest_at(self, data: bytes, text: str, at: int) -> int:
        """The longest entry that starts at ``at``; ``text`` is ``data`` as Latin-1."""
        n = self.automaton.longest_prefix(text[at : at + self.longest])
        while (found := self.rank.get(data[at : at + n])) is None:
            n -= 1
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is an entry is that entry."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        token, n, text = self.token, len(data), data.decode("latin-1")
        # the automaton's own walk takes the longest entry each time; where two don't fit, the search goes on from there
        ids = [r for _, r in self.automaton.iter_long(text)]
        beside, at = self.beside, 0
        for i, pair in enumerate(pairwise(ids), 1):
            at += len(token[pair[0]])
            if not beside[pair]:
                break
        else:
            return ids
        r = ids[i]
        del ids[i:]
        dead = bytearray(n + 1)  # 1: the rest from here was tried and leads nowhere
        while True:
            to = at + len(token[r])
            if not dead[to] and (not ids or beside[ids[-1], r]):
                ids.append(r)
                at = to
                if at == n:
                    return ids
                r = self.longest_at(data, text, at)
            else:
                r = self.shorter[r]
                while r < 0:
                    dead[at] = 1
                    last = ids.pop()
                    at -= len(token[last])
                    r = self.shorter[last]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out += self.encode_piece(piece.encode())
        return out

    def piece(self, piece: str) -> str:
        """The ids of a piece as text."""
        return " ".join([self.digits[r] for r in self.encode_piece(piece.encode())])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, digest of the ids, digest of the decoded bytes, a block of pieces at a time."""
        pieces = self.split(text)
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(pieces), 4096):
            block = " ".join(map(self.pieces.__getitem__, pieces[i : i + 4096]))
            found = block.split(" ")
            n += len(found)
            if i:
                ids.update(b" ")
            ids.update(block.encode())
            back.update(b"".join(map(self.spelled.__getitem__, found)))
        return n, ids.hexdigest(), back.hexdigest()


_held: dict[int, Tokenizer] = {}


def _tokenizer(ranks, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker and broadcast."""
    if ranks.value is None:
        raise ValueError("no ranks")
    key = hash((ranks.value, pattern))
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizer(ranks.value, pattern)
    return _held[key]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, token_ids (array of int) and decoded (binary) of every document."""
    path, pattern = _defaults(path, pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # fixed size, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(ranks, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [t.encode(x or "") for x in part.column(1).to_pylist()]
                back = [t.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())],
                    ["doc_id", "token_ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, token_ids array<int>, decoded binary"
    )


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, streamed a batch at a time."""
    path, pattern = _defaults(path, pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # fixed size, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(ranks, pattern)
        for batch in batches:
            rows = [t.digest(x.as_py() or "") for x in batch.column(1)]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
