"""Removal of every byte in a 200-byte string that starts anywhere else, with suffix arrays of shards.

Windows of 200 bytes are dealt out by seed (see `repeats`): a maximal run of windows with one shared seed
is a *context*. Each batch sends every distinct context once to the shard of its seed, with
whether it occurs there twice. A shard keeps one copy of equal contexts (by two 64-bit fingerprints), sorts the suffixes of what is
left by induced sorting, computes the permuted common prefixes byte by byte, and reads off which windows share 200 bytes with another; all windows of a context
that occurs twice are repeats without sorting. Equal windows have equal seeds, so every repeat lies in one shard, also within one
document. Of a hot seed (more than `repeats.HOT_RUNS` runs, and more than a millionth of all), such as one in a passage that a third of all
documents hold, each window is a context of its own and goes by its two fingerprints alone, without induced sorting, so no shard has to hold all surroundings of one passage:
128 bits, which two different windows share with a probability of 2e-11 among 1e14. The answer to a batch is, for each context, the runs of repeated windows.

Nulls: a null text is empty. Repeated rows count as occurrences of each other. Texts of under 200 bytes
stay whole. Empty tables give empty results; columns beyond doc_id and text aren't read. A very long text is one block of one batch; its contexts
are dealt out by seed like those of other texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .suffix import repeats, suffix_array

WINDOW = 200
GRAM = 32
#: Another base for second fingerprints.
OTHER = 0xA0761D6478BD642F & ~7 | 5
#: Bytes of distinct contexts whose suffixes are sorted at once.
SORT_BYTES = 2 << 20


def _windows(buf: np.ndarray, off: np.ndarray, n: int, k: int, several: bool = False) -> tuple[np.ndarray, ...]:
    """Seed of each window by its start, and whether it lies in one text. several: also the seeds that stand at two places."""
    seed, ok = np.zeros(len(buf), np.uint64), np.zeros(len(buf), bool)
    if len(buf) < n:
        return (seed, ok, seed[:0])[: 2 + several]
    ok = np.arange(len(buf)) + n <= np.repeat(off[1:], np.diff(off))
    pre = K.prefix(K.BYTE[buf], K.BASE)
    inv = K.powers(K.BASE, len(pre))[1]
    grams = K.mix((pre[k:] - pre[:-k]) * inv[: len(buf) - k + 1])
    seed[: len(buf) - n + 1] = K.sliding(np.minimum, grams, n - k + 1)
    if several:
        found, count = np.unique(grams[K.minimizers(grams, n - k + 1)], return_counts=True)
        return seed, ok, found[count > 1]
    return seed, ok


def _runs(seed: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last window of each maximal run with one seed (texts lie n - 1 invalid windows apart)."""
    head = ok.copy()
    head[1:] &= ~((seed[1:] == seed[:-1]) & ok[:-1])
    tail = ok.copy()
    tail[:-1] &= ~((seed[1:] == seed[:-1]) & ok[1:])
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _contexts(buf: np.ndarray, off: np.ndarray, keys: np.ndarray, hot: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Starts, ends (in windows), seeds, two fingerprints of the contexts of a block whose seeds are among the keys, and whether the seed is hot."""
    seed, ok = _windows(buf, off, n, k)
    a, b = _runs(seed, ok)
    mine = R.within(seed[a], keys)
    a, b = a[mine], b[mine]
    is_hot = R.within(seed[a], hot)
    if is_hot.any():
        size = np.where(is_hot, b - a, 1)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        single = np.repeat(is_hot, size)
        a, b = np.repeat(a, size) + step, np.where(single, np.repeat(a, size) + step + 1, np.repeat(b, size))
        is_hot = single
    none = np.zeros(0, np.uint64)
    prints, checks = (K.ranges(K.prefix(K.BYTE[buf], base), a, b + n - 1, base) if len(a) else none for base in (K.BASE, OTHER))
    return a, b, seed[a], prints, checks, is_hot


def _gather(buf: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    to = np.cumsum(size)
    return buf[np.repeat(a - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)]


def _portions(contexts: np.ndarray, seed: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Contexts in portions of about SORT_BYTES; those of one seed stay together."""
    if not len(contexts):
        return []
    contexts = contexts[np.argsort(seed[contexts], kind="stable")]
    load = np.cumsum(size[contexts]) // SORT_BYTES
    head = np.concatenate(([True], seed[contexts][1:] != seed[contexts][:-1]))
    group = np.cumsum(head) - 1
    of_group = load[np.flatnonzero(head)]
    return np.split(contexts, np.flatnonzero(np.diff(of_group[group])) + 1)


def _repeated(text: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """For each byte of the concatenated contexts, whether the window that starts there occurs twice."""
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + size - n + 1, -1)
    return repeats(text, suffix_array(text), n, np.cumsum(mark[:-1]) > 0)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, removed (maximal runs of removed bytes as [first, end)), kept (binary)."""
    based, n_batches = R.in_batches(docs)

    def seeds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seed, ok, several = _windows(buf, off, window, gram, several=True)
        a, _ = _runs(seed, ok)
        return seed[a], np.searchsorted(off, a, "right") - 1, R.within(seed[a], several)

    def runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        seed, ok = _windows(buf, off, window, gram)
        return seed[_runs(seed, ok)[0]]

    hot = docs.sparkSession.sparkContext.broadcast(R.hot_seeds(based, n_batches, runs))
    shared = R.shared_seeds(based, n_batches, seeds)

    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        keys = R.unblob(told.column("keys"), np.uint64)
        parts: list[tuple] = []
        batch = 0
        for rows, buf, off in R.table_blocks(docs):
            batch = rows.column(rows.schema.get_field_index("batch"))[0].as_py()
            a, b, seed, prints, checks, is_hot = _contexts(buf, off, keys, hot.value, window, gram)
            first, _, count = R.distinct(prints, checks)
            size = np.where(is_hot[first], 0, b[first] - a[first] + window - 1)
            parts.append((np.where(is_hot, prints, seed)[first], prints[first], checks[first], count, size, _gather(buf, a[first], size)))
        got = []
        if parts:
            seed, prints, checks, count, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            first, back, _ = R.distinct(prints, checks)
            twice = np.bincount(back, weights=count, minlength=len(first)) > 1
            begin = np.cumsum(size) - size
            for shard, part in R.by_group(seed[first] % K.U64(n_batches)):
                at = first[part]
                got.append((shard, batch, prints[at].tobytes(), checks[at].tobytes(), seed[at].tobytes(), twice[part].tobytes(), size[at].astype(np.int32).tobytes(), _gather(text, begin[at], size[at]).tobytes()))
        shard, source, *rest = zip(*got, strict=True) if got else [()] * 8
        return pa.table([pa.array(shard, pa.int32()), pa.array(source, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], names=["shard", "batch", "prints", "checks", "seeds", "twice", "sizes", "text"])

    sent = based.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(send, "shard int, batch int, prints binary, checks binary, seeds binary, twice binary, sizes binary, text binary")

    def sort(table: pa.Table) -> pa.Table:
        prints, checks, twice = R.unblob(table.column("prints"), np.uint64), R.unblob(table.column("checks"), np.uint64), R.unblob(table.column("twice"), np.bool_)
        size, text = R.unblob(table.column("sizes"), np.int32).astype(np.int64), R.unblob(table.column("text"), np.uint8)
        source = np.repeat(table.column("batch").to_numpy(), R.lengths(table.column("prints"), np.uint64))
        begin = np.cumsum(size) - size
        first, back, count = R.distinct(prints, checks)
        own = prints[first]
        whole = (count > 1) | (np.bincount(back, weights=twice, minlength=len(own)) > 0)
        start = np.cumsum(size[first]) - size[first]
        # a seed with one context, all of whose windows are repeats already, has nothing to sort
        _, which, alike = np.unique(R.unblob(table.column("seeds"), np.uint64)[first], return_inverse=True, return_counts=True)
        again = np.zeros(int(size[first].sum()), bool)
        for part in _portions(np.flatnonzero(((alike[which] > 1) | ~whole) & (size[first] > 0)), which, size[first]):
            place = np.repeat(start[part] - (np.cumsum(size[first][part]) - size[first][part]), size[first][part])
            here = np.cumsum(size[first][part]) - size[first][part]
            again[place + np.arange(len(place))] = _repeated(_gather(text, begin[first][part], size[first][part]), here, size[first][part], window)
        # per distinct context, its runs of repeated windows
        mask = np.repeat(whole, size[first])
        last = np.repeat(start + size[first] - window, size[first])
        mask = (mask | again) & (np.arange(len(mask)) <= last)
        a, b = K.spans(mask)
        owner = np.searchsorted(start + size[first], a, "right")
        # windows of hot seeds came without text
        bare = np.flatnonzero(whole & (size[first] == 0))
        a, b, owner = np.concatenate((a, start[bare])), np.concatenate((b, start[bare] + 1)), np.concatenate((owner, bare))
        order = np.argsort(owner, kind="stable")
        a, b, owner = a[order], b[order], owner[order]
        lo, hi = np.searchsorted(owner, np.arange(len(own))), np.searchsorted(owner, np.arange(len(own)), "right")
        got = []
        for batch, part in R.by_group(source):
            mine = back[part]
            mine = mine[hi[mine] > lo[mine]]
            k = hi[mine] - lo[mine]
            runs = np.repeat(lo[mine] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            base = start[owner[runs]]
            got.append((batch, 1, own[owner[runs]].tobytes(), (a[runs] - base).astype(np.int32).tobytes(), (b[runs] - base).astype(np.int32).tobytes()))
        batch, kind, keys, x, y = zip(*got, strict=True) if got else [()] * 5
        return pa.table([pa.array(batch, pa.int32()), pa.array(kind, pa.int32()), pa.array(keys, pa.binary()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["batch", "kind", "keys", "first", "end"])

    found = sent.groupBy("shard").applyInArrow(sort, "batch int, kind int, keys binary, first binary, end binary")

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        kind = told.column("kind").to_numpy()
        keys = R.unblob(told.column("keys").filter(pa.array(kind == 0)), np.uint64)
        mine = told.filter(pa.array(kind == 1))
        prints = R.unblob(mine.column("keys"), np.uint64)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        x, y = (R.unblob(mine.column(c), np.int32)[order].astype(np.int64) for c in ("first", "end"))
        counts, removed, kept = [], [], []
        for _, buf, off in R.table_blocks(docs):
            a, _, _, own, _, _ = _contexts(buf, off, keys, hot.value, window, gram)
            lo, hi = np.searchsorted(prints, own), np.searchsorted(prints, own, "right")
            k = hi - lo
            runs = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            base = np.repeat(a, k)
            mark = np.zeros(len(buf) + 1, np.int64)
            np.add.at(mark, base + x[runs], 1)
            np.add.at(mark, base + y[runs] + window - 1, -1)
            gone = np.cumsum(mark[:-1]) > 0
            raw = buf.tobytes()
            for t, u in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                counts.append(u - t)
                own_gone = gone[t:u]
                if not own_gone.any():
                    removed.append([])
                    kept.append(raw[t:u])
                else:
                    removed.append(np.stack(K.spans(own_gone), 1).tolist())
                    kept.append(buf[t:u][~own_gone].tobytes())
        return pa.table([docs.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    none = F.lit(None).cast("binary")
    told = shared.select("batch", "kind", "keys", none.alias("first"), none.alias("end")).unionByName(found)
    schema = "doc_id long, n_bytes long, removed array<array<long>>, kept binary"
    return based.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, schema)


def digests(found: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every window."""
    raw = {doc: (text or "").encode() for doc, text in docs}
    seen: dict[bytes, int] = {}
    for t in raw.values():
        for i in range(len(t) - window + 1):
            h = hashlib.blake2b(t[i : i + window], digest_size=16).digest()
            seen[h] = seen.get(h, 0) + 1
    out = []
    for doc, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[hashlib.blake2b(t[i : i + window], digest_size=16).digest()] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
