"""Which windows of the texts can occur twice: the exchange that substring operators share.

A window's *seed* is the least hash of the k-grams in it, so equal windows have equal seeds, and
consecutive windows mostly share one. Three exchanges find repeats without pairs and without collecting a
group; what is broadcast is the list of hot seeds, which is bounded:

1. Each task asks, once for each of its seeds, whether the seed occurs elsewhere. The answer goes back
   to the seed's *batch* (a hash group of documents of bounded size). A seed that a task has seen
   twice is known to be shared and only announced, so a seed that a third of all documents hold is
   sent once by each task, not once by each document.
2. Documents are dealt out by batch and meet the answers there; windows without a shared seed are done.
   The operator sends what is left, once for each batch, to buckets by content.
3. Buckets answer to batches again.

Sizes of batches and buckets are bounded; their numbers grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, text_bytes

#: Bytes of text in a batch, and about as many for each bucket.
BATCH_BYTES = 6 << 20
#: Bytes of text after which a task sends what it has gathered.
FLUSH_BYTES = 24 << 20
#: A seed is hot beyond HOT_RUNS runs and a HOT_SEEDS-th of all; so the list of hot seeds, which all tasks hold, has at most HOT_SEEDS numbers (8 MB).
HOT_RUNS = 4096
HOT_SEEDS = 1_000_000
SEVERAL = np.uint32(0xFFFFFFFF)
ASK, KNOWN = 0, 1

#: From a block (bytes, offsets): for each run of windows with one seed, the seed, the text's number and whether the seed occurs twice in the run.
Seeds = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def in_batches(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """doc_id, text, batch (and rest, a struct of the columns to keep), and the number of batches."""
    n = max(8, -(-text_bytes(docs) // BATCH_BYTES))
    rest = [F.struct(*[docs[c] for c in keep]).alias("rest")] if keep else []
    key = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(n)).cast("int").alias("batch")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *rest, key), n


def by_group(key: np.ndarray, n_sorted: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) for each value of key."""
    if not len(key):
        return
    if n_sorted:
        order = np.arange(len(key))
    else:
        # two bytes are sorted by radix
        short = key.astype(np.uint16) if int(key.min()) >= 0 and int(key.max()) < 1 << 16 else key
        order = np.argsort(short, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut):
        yield int(key[part[0]]), part


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b): where each stands first, which one each place holds, and how often each stands."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    head = np.ones(len(x), bool)
    head[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return order[at], back, np.diff(np.append(at, len(x)))


def blobs(x: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in x], pa.binary())


def unblob(col: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """All values of a binary column, in order."""
    parts = [np.frombuffer(x, dtype) for x in col.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts with as many bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def widen(raw: bytes, n: int) -> np.ndarray:
    """n counts as int64, from bytes of narrow()."""
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else np.uint8).astype(np.int64)


def lengths(col: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.fromiter((len(x) for x in col.to_pylist()), np.int64, len(col)) // np.dtype(dtype).itemsize


def hot_seeds(based: DataFrame, n: int, runs_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The hot seeds, sorted: those with more than HOT_RUNS runs, and more than a HOT_SEEDS-th of all, so there are at most HOT_SEEDS.
    runs_of gives the seeds of a block's runs. Counted are seeds that
    a task meets twice in FLUSH_BYTES of text; a seed that it meets once there is far from hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            seed, runs = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            total, many = int(runs.sum()), runs > 1
            gathered.clear()
            rows = [(b, seed[many][part].tobytes(), runs[many][part].astype(np.int64).tobytes(), 0) for b, part in by_group((seed[many] % K.U64(n)).astype(np.int64))]
            bucket, keys, counts, runs = zip(*rows, (0, b"", b"", total), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(runs, pa.int64())], names=["bucket", "keys", "counts", "runs"])

        for _, buf, off in K.pieces(batches):
            gathered.append(runs_of(buf, off))
            size += len(buf)
            if size >= FLUSH_BYTES:
                yield send()
                size = 0
        yield send()

    def heavy(table: pa.Table) -> pa.Table:
        seed, runs = unblob(table.column("keys"), np.uint64), unblob(table.column("counts"), np.int64)
        own, at = np.unique(seed, return_inverse=True)
        total = np.bincount(at, weights=runs, minlength=len(own)).astype(np.int64)
        hot = np.flatnonzero(total > HOT_RUNS)
        # a row without a seed for the bucket's runs
        return pa.table([pa.array([None, *own[hot].view(np.int64).tolist()], pa.int64()), pa.array([int(table.column("runs").to_numpy().sum()), *total[hot].tolist()], pa.int64())], names=["seed", "runs"])

    found = based.select("text").mapInArrow(count, "bucket int, keys binary, counts binary, runs long").groupBy("bucket").applyInArrow(heavy, "seed long, runs long")
    found = checkpointed(found)
    total = found.where("seed IS NULL").agg(F.sum("runs")).first()[0] or 0
    return np.sort(np.array([r["seed"] for r in found.where("seed IS NOT NULL").where(F.col("runs") > total // HOT_SEEDS).select("seed").collect()], np.int64).view(np.uint64))


def shared_seeds(based: DataFrame, n: int, seeds: Seeds) -> DataFrame:
    """(batch, kind 0, keys): for each batch, its seeds that occur elsewhere too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            if not gathered:
                return
            seed, batch, twice = (np.concatenate(x) for x in zip(*gathered, strict=True))
            gathered.clear()
            order = np.argsort(seed, kind="stable")
            seed, batch, twice = seed[order], batch[order], twice[order]
            head = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1]))) if len(seed) else np.zeros(0, np.int64)
            several = np.diff(np.append(head, len(seed))) > 1
            if len(head):
                several |= np.logical_or.reduceat(twice, head)
            rows: list[tuple[int, int, bytes, bytes]] = []
            own, where = seed[head], np.where(several, SEVERAL, batch[head])
            for bucket, part in by_group(own % K.U64(n)):
                rows.append((bucket, ASK, own[part].tobytes(), where[part].tobytes()))
            told = np.repeat(several, np.diff(np.append(head, len(seed))))
            for b, part in by_group(batch[told]):
                rows.append((b % n, KNOWN, np.unique(seed[told][part]).tobytes(), np.uint32(b).tobytes()))
            if rows:
                bucket, kind, a, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(w, pa.binary())], names=["bucket", "kind", "keys", "where"])

        for rows, buf, off in K.pieces(batches):
            seed, text, twice = seeds(buf, off)
            batch = rows.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            gathered.append((seed, batch[text], twice))
            size += len(buf)
            if size >= FLUSH_BYTES:
                yield from send()
                size = 0
        yield from send()

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        asked, known = table.filter(pa.array(kind == ASK)), table.filter(pa.array(kind == KNOWN))
        seed, where = unblob(asked.column("keys"), np.uint64), unblob(asked.column("where"), np.uint32)
        order = np.argsort(seed, kind="stable")
        seed, where = seed[order], where[order]
        twin = np.zeros(len(seed), bool)
        same = seed[1:] == seed[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        go = twin & (where != SEVERAL)
        out = [(b, seed[go][part].tobytes()) for b, part in by_group(where[go])]
        out += [(int(np.frombuffer(w, np.uint32)[0]), k) for w, k in zip(known.column("where").to_pylist(), known.column("keys").to_pylist(), strict=True)]
        batch, keys = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(batch, pa.int32()), pa.array([0] * len(batch), pa.int32()), pa.array(keys, pa.binary())], names=["batch", "kind", "keys"])

    asked = based.select("text", "batch").mapInArrow(ask, "bucket int, kind int, keys binary, where binary")
    return asked.groupBy("bucket").applyInArrow(answer, "batch int, kind int, keys binary")


def within(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    keys = np.sort(keys)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def table_blocks(table: pa.Table, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    yield from K.pieces(iter(table.to_batches()), limit=limit)
