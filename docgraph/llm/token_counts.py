"""Token counts that follow edits, with a segment tree of chunks for each document.

A leaf holds the bytes and tokens of one chunk (a pre-token with its white space, see `tokens`); inner nodes hold sums.
Where a chunk ends depends on two neighbouring bytes only, so an edit re-encodes the leaves that it
touches and one leaf on either side as boundary context. The chunks of that region take the place of these leaves, spread
over the smallest subtree that has room for them (a quarter of the root's leaves stay free, fewer further down), and only this
subtree and its ancestors get new sums; when the root has no room, the tree doubles. So leaves stay single
chunks however many edits meet at one place, and an edit encodes what it inserts and some chunks. Counts equal those of the whole new text.

Trees travel as one binary column: bytes, then tokens of the leaves (int32), from which loading adds up the inner nodes without encoding.
Nulls: a null text is empty; null edits are none. Edits are applied in order, each to the text that the one before left; their byte
offsets are clipped to the text and moved down to the start of a character; an end before its start is the start. Repeated rows are rows
of their own, and empty tables give empty results. `build` keeps all columns, but replaces those named n_tokens and tree; elsewhere columns beyond
those named are not read. A very long text is one block and one tree; a run without cuts (such as a megabyte of letters) is one chunk, which an edit in it encodes anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .tokens import Encoder, chunks, encoder


class Tree:
    """Sums of bytes, tokens and used leaves, as heaps."""

    def __init__(self, bytes_: np.ndarray, tokens: np.ndarray):
        n = max(1, len(bytes_))
        self.size = 1 << (n + n // 3).bit_length()
        self.sums = np.zeros((3, 2 * self.size), np.int64)
        self._spread(0, self.size, np.stack((bytes_, tokens)).astype(np.int64))

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        return cls(*np.frombuffer(raw, np.int32).reshape(2, -1))

    def dump(self) -> bytes:
        leaves = self.sums[:, self.size :]
        return leaves[:2, leaves[2] > 0].astype(np.int32).tobytes()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, byte: int) -> tuple[int, int]:
        """The leaf that holds a byte (the last leaf with bytes, beyond the end) and where the leaf starts."""
        at, before = 1, 0
        byte = min(byte, int(self.sums[0, 1]) - 1)
        while at < self.size:
            at *= 2
            if byte - before >= self.sums[0, at]:
                before += int(self.sums[0, at])
                at += 1
        return at - self.size, before

    def _spread(self, low: int, width: int, leaves: np.ndarray) -> None:
        """The leaves, evenly over the subtree of `width` leaves from `low`; new sums there and above."""
        a, n = low + self.size, leaves.shape[1]
        self.sums[:, a : a + width] = 0
        at = a + np.arange(n) * width // max(1, n)
        self.sums[:2, at], self.sums[2, at] = leaves, 1
        while a > 1:
            a, width = a // 2, max(1, width // 2)
            self.sums[:, a : a + width] = self.sums[:, 2 * a : 2 * (a + width) : 2] + self.sums[:, 2 * a + 1 : 2 * (a + width) : 2]

    def put(self, first: int, last: int, bytes_: np.ndarray, tokens: np.ndarray) -> None:
        """New leaves in place of those from `first` to `last`."""
        new = np.stack((bytes_, tokens)).astype(np.int64)
        width, height, top = 1, 0, self.size.bit_length() - 1
        while True:
            low = first // width * width
            high = low + width
            if high > last:
                left, right = (self.sums[:, self.size + x : self.size + y] for x, y in ((low, first), (last + 1, high)))
                used = int(left[2].sum() + right[2].sum()) + new.shape[1]
                # 1 for a leaf, 3/4 for the root
                if used <= width * (1 - height / max(1, top) / 4):
                    break
            if width == self.size:
                break
            width, height = width * 2, height + 1
        leaves = np.concatenate((left[:2, left[2] > 0], new, right[:2, right[2] > 0]), axis=1)
        if used > width * (1 - height / max(1, top) / 4):
            self.__init__(*leaves)  # the root is too small
        else:
            self._spread(low, width, leaves)


def _touched(tree: Tree, text: bytes, start: int, end: int, new: bytes) -> tuple[int, int, bytes, bytes]:
    """First and last leaf that an edit re-encodes, their new bytes, and the new text."""

    def whole(at: int) -> int:
        at = min(max(at, 0), len(text))
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    start = whole(start)
    end = max(start, whole(end))
    if not text:
        return 0, 0, new, new
    # one leaf more on either side of what is touched
    first, a = tree.find(max(start - 1, 0))
    if a > 0:
        first, a = tree.find(a - 1)
    last, b = tree.find(end)
    b += int(tree.sums[0, last + tree.size])
    if b < len(text):
        last, b = tree.find(b)
        b += int(tree.sums[0, last + tree.size])
    return first, last, text[a:start] + new + text[end:b], text[:start] + new + text[end:]


def edit(tree: Tree, text: bytes, start: int, end: int, new: bytes, enc: Encoder) -> tuple[bytes, int]:
    """The new text and how many bytes were encoded; updates the tree."""
    texts = [text]
    (done,) = _edit_all([tree], texts, [[{"start": start, "end": end, "text": new.decode()}]], enc)
    return texts[0], done


def _edit_all(trees: list[Tree], texts: list[bytes], edits: list[list | None], enc: Encoder) -> list[int]:
    """Applies all edits in rounds, one edit of each text at a time, so that a round's regions are encoded together. Returns encoded bytes."""
    todo = [[e for e in (own or []) if e is not None] for own in edits]
    done = [0] * len(trees)
    for turn in range(max(map(len, todo), default=0)):
        at = [i for i, own in enumerate(todo) if len(own) > turn]
        plans = []
        for i in at:
            e = todo[i][turn]
            plans.append(_touched(trees[i], texts[i], e["start"] or 0, e["end"] or 0, (e["text"] or "").encode()))
        off = np.concatenate(([0], np.cumsum([len(p[2]) for p in plans])))
        buf = np.frombuffer(b"".join(p[2] for p in plans), np.uint8)
        start, end, first = chunks(buf, off)
        size = end - start
        tokens = enc.counts(buf, start, end) if len(start) else size
        for i, (a, b, region, now), lo, hi in zip(at, plans, first[:-1].tolist(), first[1:].tolist(), strict=True):
            trees[i].put(a, b, size[lo:hi], tokens[lo:hi])
            texts[i] = now
            done[i] += len(region)
    return done


def _trees(buf: np.ndarray, off: np.ndarray, enc: Encoder) -> list[Tree]:
    start, end, first = chunks(buf, off)
    size = end - start
    tokens = enc.counts(buf, start, end) if len(start) else size
    return [Tree(size[a:b], tokens[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


AFTER = "doc_id long, text string, n_tokens long, n_before long, encoded_bytes long"


def count_edited(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text, edits) after their edits, without storing the trees: doc_id, text, n_tokens, n_before, encoded_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows, buf, off in K.pieces(batches, limit=1 << 20):
            trees, raw = _trees(buf, off, enc), buf.tobytes()
            texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            before = [t.tokens for t in trees]
            done = _edit_all(trees, texts, rows.column(2).to_pylist(), enc)
            cols = [rows.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), *(pa.array(x, pa.int64()) for x in ([t.tokens for t in trees], before, done))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_tokens", "n_before", "encoded_bytes"])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, AFTER)


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text, further columns) with n_tokens and tree, in place of such columns of the input."""

    docs = docs.drop("n_tokens", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows, buf, off in K.pieces(batches):
            trees = _trees(buf, off, enc)
            cols = [*rows.columns, pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rows.schema.names, "n_tokens", "tree"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add("n_tokens", "long").add("tree", "binary"))


def apply_edits(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of build() with a column edits (array of start, end, text: bytes [start, end) become the text).
    Returns doc_id, text, tree, n_tokens (all after the edits), n_before and encoded_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                text, raw, edits = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("text", "tree", "edits"))
                texts, trees = [(t or "").encode() for t in text], [Tree.load(r) for r in raw]
                before = [t.tokens for t in trees]
                done = _edit_all(trees, texts, edits, enc)
                ids = rows.column(rows.schema.get_field_index("doc_id"))
                cols = [ids, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), *(pa.array(x, pa.int64()) for x in ([t.tokens for t in trees], before, done)), pa.array([t.dump() for t in trees], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_tokens", "n_before", "encoded_bytes", "tree"])

    return trees.select("doc_id", "text", "tree", "edits").mapInArrow(run, AFTER + ", tree binary")
