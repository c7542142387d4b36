"""SuperMinHash signatures of shingle sets.

Each element draws, for ranks 0, 1, 2, ..., a slot of a random permutation and a fraction; slot p
gets the least rank + fraction of all elements. Ranks are drawn for all elements of a block at
once, one rank after the other. When every slot of a set holds a value of rank r or less, no later
rank can change it and the set is done: large sets stop after the first rank.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

SLOTS = 128


def _draw(elements: np.ndarray, rank: int) -> np.ndarray:
    return K.mix(elements + K.U64((rank + 1) * 0x9E3779B97F4A7C15 & K.MASK))


def signatures(elements: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of `slots` uint32 per set. elements: hashes, set after set; first: offsets (n + 1). A slot's value orders rank and fraction."""
    n = len(first) - 1
    best = np.full(n * slots, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    live, mine = elements, owner
    perm: np.ndarray | None = None
    step = np.uint32(0xFFFFFFFF // (slots + 1))
    for rank in range(slots):
        draw = _draw(live, rank)
        to = rank + ((draw >> K.U64(32)) * K.U64(slots - rank) >> K.U64(32)).astype(np.int64)
        value = (np.uint32(rank) * step + ((draw & K.U64(0xFFFFFFFF)) * K.U64(int(step)) >> K.U64(32)).astype(np.uint32)).astype(np.uint32)
        if perm is None:
            slot = to
        else:
            i = np.arange(len(live))
            slot = perm[i, to].astype(np.int64)
            perm[i, to] = perm[:, rank]
            perm[:, rank] = slot
        np.minimum.at(best, mine * slots + slot, value)
        done = best.reshape(n, slots).max(axis=1) < np.uint32(rank + 1) * step
        more = ~done[mine]
        if not more.any():
            break
        if perm is None:
            at = np.flatnonzero(more)
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(at), slots)).copy()
            perm[np.arange(len(at)), to[at]] = 0
            perm[:, 0] = to[at]
        else:
            perm = perm[more]
        live, mine = live[more], mine[more]
    return best.reshape(n, slots)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band of `rows` slots; equal bands of different numbers differ."""
    n, slots = signature.shape
    x = signature[:, : slots // rows * rows].reshape(n, -1, rows).astype(np.uint64)
    out = np.broadcast_to(K.mix(np.arange(x.shape[1], dtype=np.uint64) + K.U64(1)), x.shape[:2]).copy()
    for k in range(rows):
        out = K.mix(out * K.U64(0x9E3779B97F4A7C15) + x[:, :, k])
    return out
