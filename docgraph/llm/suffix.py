"""Suffix arrays by induced sorting, vectorised over buckets, and permuted common prefixes, vectorised over irreducible places.

Suffixes are classified as S (smaller than the next) or L; the leftmost S of each run starts a
substring. Sorting these substrings by an induced pass names them; equal names are resolved on the
reduced string; then one pass over the buckets from left to right induces the L suffixes and one
from right to left the S suffixes. A whole bucket is induced at once, and the suffixes that a bucket
induces into itself (runs of one byte) are laid out by run length, so the work is linear.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last one is."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    out = np.ones(n, bool)
    if len(change):
        rises = s[change] < s[change + 1]
        out[: change[-1] + 1] = np.repeat(rises, np.diff(change, prepend=-1))
    return out


def _extend(front: np.ndarray, run: np.ndarray) -> np.ndarray:
    """front and what it induces into its own bucket, in the order of a scan: run says how many equal bytes stand before a position."""
    r = run[front]
    total = int(r.sum())
    if not total:
        return front
    which = np.repeat(np.arange(len(front)), r)
    step = np.arange(total) - np.repeat(np.cumsum(r) - r, r)
    order = np.argsort(step, kind="stable")
    return np.concatenate((front, front[which[order]] - 1 - step[order].astype(front.dtype)))


def _induce(s: np.ndarray, is_s: np.ndarray, starts: list[np.ndarray], run: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """L and S suffixes of each bucket, sorted, from the sorted starts of each bucket."""
    none = np.zeros(0, np.int32)
    queue: list[list[np.ndarray]] = [[] for _ in range(size)]
    left: list[np.ndarray] = [none] * size

    def deal(at: np.ndarray, to_s: bool) -> None:
        at = at[at > 0] - 1
        at = at[is_s[at] == to_s]
        if not len(at):
            return
        c = s[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cut = np.flatnonzero(c[1:] != c[:-1]) + 1
        bounds = [0, *cut.tolist(), len(at)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            queue[c[a]].append(at[a:b])

    for c in range(size):
        own = _extend(np.concatenate(queue[c]), run) if queue[c] else none
        left[c] = own
        both = np.concatenate((own, starts[c]))
        if len(both):
            at = both[both > 0]
            deal(at[s[at - 1] > c], False)
    queue = [[] for _ in range(size)]
    right: list[np.ndarray] = [none] * size
    for c in range(size - 1, -1, -1):
        own = _extend(np.concatenate(queue[c]), run) if queue[c] else none
        right[c] = own[::-1]
        both = np.concatenate((own, left[c][::-1]))
        if len(both):
            at = both[both > 0]
            deal(at[s[at - 1] < c], True)
    return left, right


def _rank_doubling(names: np.ndarray) -> np.ndarray:
    """Sorted positions of the suffixes of the reduced string: ranks by as many names as fit a number, then, among equal ranks only, by twice as many each round."""
    n = len(names)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(names.max() + 1).bit_length()
    h = max(1, 62 // bits)
    padded = np.concatenate((names.astype(np.int64) + 1, np.zeros(h, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the end
    at, key = np.arange(n), key[order]
    while len(at):
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(at)))
        rank[order[at]] = np.repeat(at[first], size)
        at = at[np.repeat(size > 1, size)]
        mine = order[at]
        key = rank[mine] * (n + 1) + rank[np.minimum(mine + h, n)] + 1
        by = np.argsort(key, kind="stable")
        order[at], key = mine[by], key[by]
        h *= 2
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a uint8 array in lexicographic order."""
    if not len(text):
        return np.zeros(0, np.int32)
    used = np.zeros(256, bool)
    used[text] = True
    dense = np.cumsum(used).astype(np.uint16)  # 0 is left for the end
    size = int(dense[-1]) + 1
    s = np.append(dense[text], np.uint16(0))
    n = len(s)
    is_s = classify(s)
    change = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    run = (np.arange(n) - np.repeat(change, np.diff(np.append(change, n)))).astype(np.int32)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1

    def by_bucket(at: np.ndarray) -> list[np.ndarray]:
        c = s[at]
        order = np.argsort(c, kind="stable")
        return np.split(at[order], np.searchsorted(c[order], np.arange(1, size)))

    left, right = _induce(s, is_s, by_bucket(lms), run, size)
    rank_of = np.full(n, -1, np.int64)
    rank_of[lms] = np.arange(len(lms))
    ordered = np.concatenate([x for c in range(size) for x in (left[c], right[c])])
    del left, right
    ordered = ordered[rank_of[ordered] >= 0] if len(lms) else lms
    if len(lms) and len(ordered) < len(lms):  # the end is a start that nothing induces
        rest = np.ones(len(lms), bool)
        rest[rank_of[ordered]] = False
        ordered = np.concatenate((lms[rest], ordered))
    if len(lms) > 1:
        stop = np.append(lms[1:] + 1, n)
        pre = K.prefix(K.BYTE[(s % 256).astype(np.uint8)] + s, K.BASE)
        ids = K.ranges(pre, lms.astype(np.int64), stop.astype(np.int64), K.BASE)[rank_of[ordered]]
        names = np.zeros(len(lms), np.int64)
        names[rank_of[ordered]] = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1])))
        lms = lms[_rank_doubling(names)]
    left, right = _induce(s, is_s, by_bucket(lms), run, size)
    out = np.concatenate([x for c in range(1, size) for x in (left[c], right[c])])
    return out


def _match(text: np.ndarray, a: int, b: int) -> int:
    """How many bytes from a and from b are equal, in blocks that double."""
    got, step = 0, 256
    while True:
        x, y = text[a + got : a + got + step], text[b + got : b + got + step]
        n = min(len(x), len(y))
        other = np.flatnonzero(x[:n] != y[:n])
        if len(other):
            return got + int(other[0])
        got, step = got + n, step * 2
        if n < step // 2:
            return got


def common_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of places, how many bytes from there are equal: eight at a time, for all pairs at once while they are many."""
    n = len(text)
    words = np.ndarray((n + 1,), "<u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,))
    out = np.zeros(len(a), np.int64)
    most = n - np.maximum(a, b)
    live = np.flatnonzero(most > 0)
    while len(live) > 64:
        differ = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)
        out[live] += np.where(differ == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
        live = live[(differ == 0) & (out[live] < most[live])]
    for i in live.tolist():
        out[i] += _match(text, int(a[i] + out[i]), int(b[i] + out[i]))
    return np.minimum(out, most)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int | None = None) -> np.ndarray:
    """For each position, the length (at most cap) of the prefix that its suffix shares with the one sorted before it.

    Where the bytes before both suffixes are equal, the length is one less than that of the position before. Only the other places are compared, byte
    for byte; together their lengths are at most 2 n log2 n.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (phi[1:] <= 0) | (text[:-1] != text[phi[1:] - 1])
    at = np.flatnonzero(own & (phi >= 0))
    out[at] = common_bytes(text, at, phi[at])
    base = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    out = out[base] - (np.arange(n) - base)
    return out if cap is None else np.minimum(out, cap)


def repeats(text: np.ndarray, sa: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """For each position that starts marks, whether its n bytes stand at another marked position too.

    Two marked suffixes share what the least common prefix between them in the array says; the most a suffix shares with any is with a marked one
    beside it. All n bytes of a marked position must lie in the text.
    """
    out = np.zeros(len(text), bool)
    at = np.flatnonzero(starts[sa])
    if len(at) > 1:
        shared = permuted_common_prefixes(text, sa)[sa]
        long = np.flatnonzero(np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1) >= n)
        out[sa[at[long]]] = True
        out[sa[at[long + 1]]] = True
    return out
