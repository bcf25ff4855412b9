"""Sums over the tasks of a barrier stage, for iterations whose data stay in their tasks.

Spark starts all tasks of such a stage together and restarts them together when one is lost. Its own exchange
between them (``allGather``) takes about a second and sends everything to everybody, so it is
used once, for addresses; after that the tasks add up arrays along a binary tree of connections, in
a millisecond or so, and every task gets the same sum to the last bit.
"""

from __future__ import annotations

import contextlib
import secrets
import socket
import struct

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Seconds that a task waits for another one before its stage fails and is run again.
PATIENCE = 600


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time just now: a barrier stage must not have more."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


class Sums:
    """Sums of arrays over all tasks of the running barrier stage; a context manager."""

    def __init__(self):
        context = BarrierTaskContext.get()
        self.rank = context.partitionId()
        infos = context.getTaskInfos()
        with socket.create_server(("", 0), backlog=4) as door:
            door.settimeout(PATIENCE)
            own = f"{infos[self.rank].address.rsplit(':', 1)[0]} {door.getsockname()[1]} {secrets.token_hex(16)}"
            addresses = [x.split(" ") for x in context.allGather(own)]
            self.parent = None
            if self.rank:
                host, port, word = addresses[(self.rank - 1) // 2]
                self.parent = self._ready(socket.create_connection((host, int(port)), PATIENCE))
                # the parent's word shows that the caller is a task of this stage
                self.parent.sendall(f"{word}{self.rank:016x}".encode())
            mine, self.children = own.split(" ")[2], {}
            expected = {c for c in (2 * self.rank + 1, 2 * self.rank + 2) if c < len(infos)}
            while len(self.children) < len(expected):
                caller = self._ready(door.accept()[0])
                said = self._read(caller, 48).decode("ascii", "replace")
                if said[:32] == mine and int(said[32:], 16) in expected:
                    self.children[int(said[32:], 16)] = caller
                else:
                    caller.close()

    @staticmethod
    def _ready(s: socket.socket) -> socket.socket:
        s.settimeout(PATIENCE)
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return s

    @staticmethod
    def _read(s: socket.socket, n: int) -> bytes:
        out = bytearray(n)
        view, at = memoryview(out), 0
        while at < n:
            got = s.recv_into(view[at:])
            if not got:
                raise ConnectionError("another task of the stage has ended")
            at += got
        return bytes(out)

    def _send(self, s: socket.socket, values: np.ndarray) -> None:
        s.sendall(struct.pack("<q", values.nbytes) + values.tobytes())

    def _take(self, s: socket.socket) -> np.ndarray:
        (n,) = struct.unpack("<q", self._read(s, 8))
        return np.frombuffer(self._read(s, n), np.float64)

    def __call__(self, *parts: np.ndarray) -> list[np.ndarray]:
        """The sum of each array over all tasks; shapes are the same in all of them."""
        shapes = [np.shape(p) for p in parts]
        total = np.concatenate([np.ravel(p).astype(np.float64) for p in parts])
        for rank in sorted(self.children):
            total = total + self._take(self.children[rank])
        if self.parent:
            self._send(self.parent, total)
            total = self._take(self.parent)
        for child in self.children.values():
            self._send(child, total)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(total, ends), shapes, strict=True)]

    def __enter__(self) -> Sums:
        return self

    def __exit__(self, *_) -> None:
        for s in (self.parent, *self.children.values()):
            if s:
                with contextlib.suppress(OSError):
                    s.close()
