"""Packing of token ids into fixed windows by minimum bin slack.

A document's ids (with one end id) are cut at the capacity: full pieces fill a sequence each, the
rest goes to a pool. The pool is a histogram of lengths; for the longest remaining piece, a
subset-sum dynamic program over a bitset (one big integer, lengths in falling order, counts split
into powers of two) finds the multiset of remaining lengths that fills the sequence closest to its capacity,
and backtracking gives how often each length is used. A multiset is applied as often as the counts
allow. Pools are packed where the documents lie, without a shuffle. Pieces of sequences with slack go back to the pool and are tried
again with new ones; of these, and at a partition's end of all that is left, more than `LOOSE` are laid end to end and cut at the capacity.
So a pool never holds more than `POOL` pieces, each pass takes most of it, and only one sequence of each partition has padding.

Nulls: a null text is empty and holds the end id alone. Repeated rows are packed as rows of their
own. An empty table gives no rows. Further columns are not read. A very long text is encoded at once; its full pieces go out before the next block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernels as K
from .tokens import encoder

CAPACITY = 2048
POOL = 4096
#: Pieces without an exact fill that wait for the next pool.
LOOSE = POOL // 4


def fill(count: dict[int, int], capacity: int) -> dict[int, int]:
    """How often to use each length, so that the sum is the largest that is at most the capacity."""
    bits, limit, trail = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in count if x <= capacity), reverse=True):
        left, k = min(count[length], capacity // length), 1
        while left:
            k = min(k, left)
            trail.append((length, k, bits))
            bits |= (bits << (length * k)) & limit
            left -= k
            k *= 2
        if bits >> capacity:
            break
    at, used = bits.bit_length() - 1, {}
    for length, k, before in reversed(trail):
        if not before >> at & 1:
            at -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(count: dict[int, int], capacity: int, keep: int = 0) -> list[tuple[dict[int, int], int]]:
    """Multisets of lengths and how often each is applied; stops when at most `keep` pieces are left."""
    count, out, left = dict(count), [], sum(count.values())
    while left > keep:
        first = max(count)
        count[first] -= 1
        used = fill({x: n for x, n in count.items() if n}, capacity - first)
        count[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(count[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            count[x] -= n * times
            left -= n * times
            if not count[x]:
                del count[x]
    return out


class Packer:
    """Rows of pieces: (row of the document, start, ids, document's ids, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence, self.pool, self.out = capacity, first_sequence, [], []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self._emit([(doc, start, ids[start : start + self.capacity], len(ids))])
        if full < len(ids):
            self.pool.append((doc, full, ids[full:].copy(), len(ids)))
            if len(self.pool) >= POOL:
                self.pack(POOL // 8)

    def pack(self, keep: int = 0) -> None:
        by: dict[int, list[tuple]] = {}
        for piece in self.pool:
            by.setdefault(len(piece[2]), []).append(piece)
        loose = []
        for used, times in plan({x: len(p) for x, p in by.items()}, self.capacity, keep):
            for _ in range(times):
                pieces = [by[x].pop() for x, n in used.items() for _ in range(n)]
                if sum(x * n for x, n in used.items()) == self.capacity:
                    self._emit(pieces)
                else:
                    loose += pieces
        cut = max(0, len(loose) - LOOSE)
        self.pool = self._lay(loose[:cut]) + loose[cut:] + [p for ps in by.values() for p in ps]

    def _lay(self, pieces: list[tuple]) -> list[tuple]:
        """Sequences of pieces laid end to end and cut at the capacity; returns the pieces of the last one, if it isn't full."""
        now, room = [], self.capacity
        for doc, start, ids, total in pieces:
            while len(ids) >= room:
                now.append((doc, start, ids[:room], total))
                start, ids = start + room, ids[room:]
                self._emit(now)
                now, room = [], self.capacity
            if len(ids):
                now.append((doc, start, ids, total))
                room -= len(ids)
        return now

    def finish(self) -> None:
        self.pack()
        rest = self._lay(self.pool)
        if rest:
            self._emit(rest)
        self.pool = []

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    docs: doc_id, text. tokenizer: path of a tokenizers JSON file, the same on all machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 36)

        def rows() -> Iterator[pa.RecordBatch]:
            got = packer.take()
            for k in range(0, len(got), 20_000):
                doc, start, ids, total, seq, at = zip(*got[k : k + 20_000], strict=True)
                cols = {
                    "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(map(len, ids), pa.int64()),
                    "ids_crc32": pa.array((zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids), pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(at, pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        for batch, buf, off in K.pieces(batches, limit=1 << 20):
            ids, first = enc.encode(buf, off)
            for doc, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
            yield from rows()
        packer.finish()
        yield from rows()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
