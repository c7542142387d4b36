"""Vectorised text kernels shared by the corpus operators.

Every kernel works on a *block*: the UTF-8 bytes of a run of texts in one uint8 array plus
the offsets of the texts in it, taken from Arrow buffers without a Python object per text.
Hashes are 64-bit polynomial hashes over random byte values with a finaliser, so one pass of
prefix sums gives the hash of any word, word window or byte window of the block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 & ~7 | 5
WORD_BASE = 0xD1B54A32D192ED03 & ~7 | 5
MASK = (1 << 64) - 1

#: Bytes that separate words in the white-space definition: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of alphanumeric words: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64 for i < n, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()

        def run(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        have = (run(base), run(pow(base, -1, 1 << 64)))
        if size <= 1 << 23:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges [start, end) over prefix sums; equal content gives equal hashes."""
    inv = powers(base, len(pre))[1]
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * U64(0x632BE59BD9B4E019))


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (int64) of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: between tasks a worker should hold little."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts hold about `limit` bytes (one text at least)."""
    for batch in batches:
        buf, off = text_column(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    trim()


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the block, and the first word of each text (n + 1 numbers)."""
    w = is_word[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty_like(w)
    after = np.empty_like(w)
    if len(w):
        before[0], before[1:] = False, w[:-1]
        after[-1], after[:-1] = False, w[1:]
    start = np.flatnonzero(w & (~before | edge[:-1]))
    end = np.flatnonzero(w & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ranges(prefix(BYTE[buf], BASE), start, end, BASE)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words for every word, and whether the n words lie in one text."""
    if len(hashes) < n:
        return np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
    pre = prefix(hashes, WORD_BASE)
    at = np.arange(len(hashes) - n + 1)
    out, ok = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
    out[: len(at)] = ranges(pre, at, at + n, WORD_BASE)
    last = np.repeat(first[1:], np.diff(first))
    ok[: len(at)] = at + n <= last[: len(at)]
    return out, ok


def sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op over x[i : i + w] for every i with a full window."""
    have, out = 1, x
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some window of w positions (winnowing).

    Equal windows choose equal positions; a run of hashes shorter than w chooses none.
    """
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    least = sliding(np.minimum, hashes, w)
    pad = np.zeros(len(hashes) + w - 1, np.uint64)
    pad[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(sliding(np.maximum, pad, w) == hashes)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
