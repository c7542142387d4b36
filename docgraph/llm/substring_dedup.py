"""Removal of repeated passages by seeds and extension.

Seeds are winnowed anchors: of the 5-word anchors in each 13-word window, the (leftmost) one with the least
hash. A maximal run of windows with one anchor is a *context*: the anchor and up to eight words on either side. Documents meet on
anchors that occur elsewhere too (see `repeats`): each batch of documents sends a context once, with its smallest doc_id there and its words, to the bucket of its
anchor. There, contexts that share the anchor are extended word by word to the left and to the right:
contexts are numbered so that two have one number as long as they agree, first over the anchor's own words, then for each
length of extension. Two windows are equal if they agree as far as the window reaches on either side, and the smallest doc_id of equal
windows keeps them. Runs of removed words are the maximal repeats over the length threshold.

No pairs are made, and the answer (which windows of a context stay) goes only to the batch that holds the first document; every other
document removes them. Words are compared by 64-bit hash, one word at a time, so two windows pass for equal only if all 13 hashes agree. Of a hot anchor (more than
`repeats.HOT_RUNS` runs, and more than a millionth of all), such as one in a passage of a third of all documents, every window is a context of its
own and goes by two 64-bit fingerprints to a bucket of its own, so no bucket holds all surroundings of one passage.

Nulls: a null text has no words; a null doc_id counts as larger than all others. Rows with equal doc_ids
keep what they share only with each other. Empty tables give empty results. Columns beyond doc_id, text and those named in `keep` aren't read. A very
long text is one block of one batch; its contexts are dealt out by anchor like those of other texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .common import LAST_ID

WINDOW = 13
ANCHOR = 5
WORD = ~K.SPACE
#: Another base for second fingerprints.
OTHER = 0xA0761D6478BD642F & ~7 | 5


def _windows(buf: np.ndarray, off: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Word starts and ends, first words, word hashes, window seeds, whether a window lies in one text, and anchors."""
    start, end, first = K.words(buf, off, WORD)
    h = K.word_hashes(buf, start, end)
    last = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(h))
    ok = at + n <= last
    seed, grams = np.zeros(len(h), np.uint64), np.zeros(0, np.uint64)
    if len(h) >= n:
        # an anchor across two texts is never in a window of one text
        pre = K.prefix(h, K.WORD_BASE)
        g = np.arange(len(h) - k + 1)
        grams = K.ranges(pre, g, g + k, K.WORD_BASE)
        seed[: len(h) - n + 1] = K.sliding(np.minimum, grams, n - k + 1)
    return start, end, first, h, seed, ok, grams


def _runs(seed: np.ndarray, ok: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """First windows of the runs with one seed in one text."""
    head = ok.copy()
    head[1:] &= ~((seed[1:] == seed[:-1]) & ok[:-1] & (owner[1:] == owner[:-1]))
    return np.flatnonzero(head)


class Contexts:
    """The contexts of a block whose seeds are among the keys: first window, number of windows, anchor (all in words), seed, fingerprints, whether the seed is hot."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, keys: np.ndarray, hot: np.ndarray, n: int, k: int):
        self.start, self.end, self.first, self.words, seed, ok, grams = _windows(buf, off, n, k)
        at = np.flatnonzero(ok & R.within(seed, keys))
        # the leftmost place of each window's anchor
        own, which = np.unique(seed[at], return_inverse=True)
        place = np.flatnonzero(R.within(grams, own)) if len(own) else np.zeros(0, np.int64)
        n_places = len(grams) + 1
        order = np.sort(np.searchsorted(own, grams[place]) * n_places + place)
        anchor = order[np.searchsorted(order, which * n_places + at)] % n_places if len(at) else at
        is_hot = R.within(seed[at], hot)
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(at) != 1) | (np.diff(anchor) != 0) | is_hot[1:]
        c = np.flatnonzero(head)
        self.a, self.n_windows, self.anchor, self.seed, self.hot = at[c], np.diff(np.append(c, len(at))), anchor[c], seed[at][c], is_hot[c]
        self.size = self.n_windows + n - 1
        none = np.zeros(0, np.uint64)
        self.prints, self.checks = (K.mix(K.ranges(K.prefix(self.words, base), self.a, self.a + self.size, base) + (self.anchor - self.a).astype(np.uint64)) if len(c) else none for base in (K.WORD_BASE, OTHER))
        self.owner = np.searchsorted(self.first, self.a, "right") - 1


def _least(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each place has the least doc of its key."""
    order = np.lexsort((doc, key))
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    number = np.cumsum(head) - 1
    out = np.empty(len(key), bool)
    out[order] = doc[order] == doc[order][head][number] if len(key) else head
    return out


def first_windows(words: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, group: np.ndarray, doc: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each context, bit i: no smaller doc has its i-th window. words: of all contexts, as small numbers; left: words before the anchor; group: anchors' numbers."""
    most = int(words.max()) + 1 if len(words) else 1

    def extended(number: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Numbers after one more word; -1 for contexts that don't reach so far."""
        out = np.full(len(number), -1, np.int64)
        ok = np.flatnonzero(reach & (number >= 0))
        _, out[ok] = np.unique(number[ok] * most + words[at[ok]], return_inverse=True)
        return out

    number, anchor = group.astype(np.int64), begin + left
    for j in range(k):
        number = extended(number, anchor + j, np.ones(len(size), bool))
    right = size - left - k
    to_left, to_right = [number], [number]
    for j in range(1, n - k + 1):
        to_left.append(extended(to_left[-1], anchor - j, left >= j))
        to_right.append(extended(to_right[-1], anchor + k + j - 1, right >= j))
    bits = np.zeros(len(size), np.int64)
    for j in range(n - k + 1):
        x, y = to_left[j], to_right[n - k - j]
        at = np.flatnonzero((x >= 0) & (y >= 0))
        mine = at[_least(x[at] * (len(size) + 1) + y[at], doc[at])]
        bits[mine] |= np.int64(1) << (left[mine] - j)
    return bits


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep: list[str] | None = None, spacing: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, removed (maximal runs of removed words as [first, end)), kept (the words
    that stay, joined by single spaces), and rest (a struct of the columns named in keep). spacing: a text that loses nothing
    keeps its own white space."""
    if not 0 <= window - anchor < 32:
        raise ValueError("a window holds its anchor and at most 31 words more")
    based, n = R.in_batches(docs, keep)

    def seeds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, _, first, _, seed, ok, _ = _windows(buf, off, window, anchor)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        at = _runs(seed, ok, owner)
        # within one text a seed counts once: what repeats there alone stays
        pair = np.unique(np.stack((owner[at].astype(np.uint64), seed[at])), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
        return pair[1].copy(), pair[0].astype(np.int64), np.zeros(pair.shape[1], bool)

    hot = docs.sparkSession.sparkContext.broadcast(R.hot_seeds(based, n, lambda buf, off: seeds(buf, off)[0]))
    shared = R.shared_seeds(based, n, seeds)

    def ids(rows: pa.RecordBatch) -> np.ndarray:
        return rows.column(rows.schema.get_field_index("doc_id")).fill_null(LAST_ID).to_numpy()

    def first_in_batch(prints: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the distinct prints, each with its smallest owner; the prints are in rising order."""
        order = np.lexsort((owners, prints))
        head = np.ones(len(order), bool)
        head[1:] = prints[order][1:] != prints[order][:-1]
        return order[head], prints[order][head]

    def dealt(prints: np.ndarray, owner: np.ndarray, seed: np.ndarray, is_hot: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Places of the distinct contexts of a batch, by rising print, and for each bucket which of these it gets."""
        at, _ = first_in_batch(prints, owner)
        return at, list(R.by_group((np.where(is_hot, prints, seed)[at] % K.U64(n)).astype(np.int64)))

    # per bucket and batch: seeds (of hot ones: both fingerprints), least doc_ids from their least on, words before the anchor, words, and these words
    names = ["seeds", "prints", "base", "ids", "lefts", "sizes", "dictionary", "codes"]

    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        keys, parts, texts, batch = R.unblob(told.column("keys"), np.uint64), [], [], 0
        for rows, buf, off in R.table_blocks(docs):
            batch = rows.column(rows.schema.get_field_index("batch"))[0].as_py()
            c = Contexts(buf, off, keys, hot.value, window, anchor)
            owner = ids(rows)[c.owner]
            at, _ = first_in_batch(c.prints, owner)
            size = np.where(c.hot[at], 0, c.size[at])
            total = np.cumsum(size)
            texts.append(c.words[np.repeat(c.a[at] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)])
            parts.append((c.prints[at], c.checks[at], c.seed[at], owner[at], (c.anchor - c.a)[at], size, c.hot[at]))
        got = []
        if parts:
            prints, checks, seed, owner, left, size, is_hot = (np.concatenate(x) for x in zip(*parts, strict=True))
            words = np.concatenate(texts)
            begin = np.cumsum(size) - size
            at, groups = dealt(prints, owner, seed, is_hot)
            for b, part in groups:
                part = at[part]
                k = size[part]
                own, codes = np.unique(words[np.repeat(begin[part] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))], return_inverse=True)
                codes = codes.astype(np.min_scalar_type(max(0, len(own) - 1)))
                bare = part[is_hot[part]]
                least = owner[part].min()
                got.append((b, batch, *(x.tobytes() for x in (
                    seed[part[~is_hot[part]]], np.stack((prints[bare], checks[bare])), least, R.narrow((owner[part] - least).view(np.uint64)), R.narrow(left[part]), R.narrow(k), own, codes,
                ))))
        cols = list(zip(*got, strict=True)) if got else [()] * (2 + len(names))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "batch", *names])

    sent = based.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(send, "bucket int, batch int, " + ", ".join(f"{c} binary" for c in names))

    def extend(table: pa.Table) -> pa.Table:
        rows = table.select(names).to_pylist()
        # a context is hot where it came without words; then it has fingerprints in place of a seed
        seeds, pairs, bases = ([np.frombuffer(r[c], t) for r in rows] for c, t in (("seeds", np.uint64), ("prints", np.uint64), ("base", np.int64)))
        counts = [len(x) + len(y) // 2 for x, y in zip(seeds, pairs, strict=True)]
        doc, left, size = (np.concatenate([R.widen(r[c], k) for r, k in zip(rows, counts, strict=True)]) for c in ("ids", "lefts", "sizes"))
        doc = doc + np.repeat(np.concatenate(bases), counts)
        seed, prints, checks = np.concatenate(seeds), *(np.concatenate([x.reshape(2, -1)[i] for x in pairs]) for i in (0, 1))
        row = np.repeat(np.arange(len(rows)), counts)
        # words as small numbers
        dictionaries = [np.frombuffer(x, np.uint64) for x in table.column("dictionary").to_pylist()]
        _, number = np.unique(np.concatenate(dictionaries), return_inverse=True)
        sizes = np.bincount(row, weights=size, minlength=len(rows)).astype(np.int64).tolist()
        words, at = [], 0
        for raw, own, count in zip(table.column("codes").to_pylist(), dictionaries, sizes, strict=True):
            if count:
                words.append(number[at : at + len(own)][np.frombuffer(raw, f"<u{len(raw) // count}")])
            at += len(own)
        words = np.concatenate(words) if words else np.zeros(0, np.int64)
        bits = np.zeros(len(size), np.int64)
        cold, bare = np.flatnonzero(size > 0), np.flatnonzero(size == 0)
        if len(cold):
            _, group = np.unique(seed, return_inverse=True)
            bits[cold] = first_windows(words, (np.cumsum(size) - size)[cold], size[cold], left[cold], group, doc[cold], window, anchor)
        if len(bare):
            _, same, _ = R.distinct(prints, checks)
            bits[bare] = _least(same, doc[bare])
        # for each batch, the bits of its contexts in the order in which it sent them
        stay = [R.narrow(x).tobytes() for x in np.split(bits, np.cumsum(counts)[:-1])]
        return pa.table([table.column("batch"), table.column("bucket"), pa.array(stay, pa.binary())], names=["batch", "bucket", "stay"])

    firsts = sent.groupBy("bucket").applyInArrow(extend, "batch int, bucket int, stay binary")

    schema = "doc_id long, n_words long, removed array<array<long>>, kept string" + (f", rest {based.schema['rest'].dataType.simpleString()}" if keep else "")

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        keys = R.unblob(told.column("keys").drop_null(), np.uint64)
        answers = told.filter(pa.compute.is_valid(told.column("stay")))
        stay = dict(zip(answers.column("bucket").to_pylist(), answers.column("stay").to_pylist(), strict=True))
        # the smallest document of each context in this batch
        blocks = list(R.table_blocks(docs))
        found = [Contexts(buf, off, keys, hot.value, window, anchor) for _, buf, off in blocks]
        owners = [ids(rows)[c.owner] for (rows, _, _), c in zip(blocks, found, strict=True)]
        prints, owner, seed, is_hot = (np.concatenate(x) for x in ([c.prints for c in found], owners, [c.seed for c in found], [c.hot for c in found]))
        at, groups = dealt(prints, owner, seed, is_hot)
        least_p, least_d, staying = prints[at], owner[at], np.zeros(len(at), np.int64)
        for bucket, part in groups:
            staying[part] = R.widen(stay[bucket], len(part))
        counts, removed, kept = [], [], []
        for (_, buf, off), c, owner in zip(blocks, found, owners, strict=True):
            start, end, first = c.start, c.end, c.first
            at = np.searchsorted(least_p, c.prints)
            bits = np.where(least_d[at] == owner, staying[at], 0) if len(at) else at
            k = c.n_windows
            step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            drop = (np.repeat(c.a, k) + step)[np.repeat(bits, k) >> step & 1 == 0]
            mark = np.zeros(len(start) + 1, np.int64)
            np.add.at(mark, drop, 1)
            np.add.at(mark, drop + window, -1)
            gone = np.cumsum(mark[:-1]) > 0
            raw = buf.tobytes()
            for t in range(len(off) - 1):
                lo, hi = int(first[t]), int(first[t + 1])
                counts.append(hi - lo)
                mine = gone[lo:hi]
                text = raw[off[t] : off[t + 1]]
                if not mine.any():
                    removed.append([])
                    kept.append((text if spacing else b" ".join(text.split())).decode("utf-8", "replace"))
                else:
                    a, b = K.spans(mine)
                    removed.append(np.stack((a, b), 1).tolist())
                    x, y = K.spans(~mine)
                    kept.append(b" ".join(b" ".join(raw[start[lo + i] : end[lo + j - 1]].split()) for i, j in zip(x.tolist(), y.tolist(), strict=True)).decode("utf-8", "replace"))
        cols = [docs.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())]
        if keep:  # all fields nullable, as declared
            rest = docs.column("rest").combine_chunks()
            cols.append(pa.StructArray.from_arrays(rest.flatten(), names=[f.name for f in rest.type]))
        return pa.table(cols, names=["doc_id", "n_words", "removed", "kept"] + ["rest"] * bool(keep))

    told = shared.select("batch", "keys").unionByName(firsts, allowMissingColumns=True)
    return based.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, schema)


def digests(found: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept words) by comparing every window."""
    split = {doc: (text or "").encode().split() for doc, text in docs}
    first: dict[tuple, int] = {}
    for doc in sorted(split):
        w = split[doc]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    out = []
    for doc, w in split.items():
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out
