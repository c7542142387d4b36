"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are maximal runs of ASCII letters and digits and of everything beyond ASCII, lower-cased in
A-Z. Each item's windows of `n` consecutive words (the whole item, if it has fewer words) are keys
of one automaton; a text is normalised to its words joined by single spaces, scanned once, and hits
are mapped back to word numbers and to byte offsets of the original text.

Items are the protected set. Up to `MAX_ITEM_BYTES` of item text are collected, broadcast and scanned for at once, with automata of about `MAX_BLOCK` key
bytes; larger sets are dealt into blocks by a hash of the item, and the texts are scanned for one block after the other, with a
checkpoint between them, so memory is bounded however many items there are and none is left out. (An item larger than the bound is a block of its own.)

Nulls: a null text or item has no words. Items without words are ignored. Items with equal windows
all count. Repeated documents are repeated rows. Empty tables give empty results; further columns
of the input are not read. A very long text is one block of its own, held with its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed

WINDOW = 10
#: Bounds on what is broadcast (ten times as many bytes of keys) and on the keys of one automaton.
MAX_ITEM_BYTES = 2 << 20
MAX_BLOCK = 8 << 20

#: Upper case to lower case, every byte outside words to a space.
NORMAL = bytes(int(K.LOWER[b]) if K.ALNUM[b] else 32 for b in range(256))


def item_windows(text: str | None, n: int = WINDOW) -> list[bytes]:
    """The normalised windows of one item, without repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))))


class Matcher:
    """Automata over the windows of all items. A window knows its length in words and its items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in item_windows(text, n):
                owners.setdefault(window, set()).add(item)
        self.lengths = np.array([w.count(b" ") + 1 for w in owners], np.int64)
        self.owners = [frozenset(o) for o in owners.values()]
        self.automata = []
        block, size = ahocorasick.Automaton(), 0
        for k, window in enumerate(owners):
            block.add_word(f" {window.decode('latin-1')} ", k)
            size += len(window) + 2
            if size > MAX_BLOCK:
                self.automata.append(block)
                block, size = ahocorasick.Automaton(), 0
        if size:
            self.automata.append(block)
        for automaton in self.automata:
            automaton.make_automaton()

    def find(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words; window numbers, first words and ends (in words) of all hits."""
        words = text.translate(NORMAL).split()
        joined = f" {b' '.join(words).decode('latin-1')} "
        hits = [hit for automaton in self.automata for hit in automaton.iter(joined)]
        if not hits:
            none = np.zeros(0, np.int64)
            return len(words), none, none, none
        at, which = np.array(hits, np.int64).T
        gaps = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        end = np.searchsorted(gaps, at)
        return len(words), which, end - self.lengths[which], end


_built: tuple[object, Matcher] | None = None


def built(items: list[tuple[str, str | None]], n: int) -> Matcher:
    """The automata of a worker; it keeps those of one set of items, built on first use."""
    global _built
    key = (n, hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).digest())
    if _built is None or _built[0] != key:
        _built = None
        _built = key, Matcher(items, n)
    return _built[1]


def item_blocks(items: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about MAX_ITEM_BYTES; one block at least."""
    own = items.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    n = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MAX_ITEM_BYTES))
    for k in range(n):
        yield sorted((r[0], r[1] or "") for r in own.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect())


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, items (sorted item ids found), word_spans (maximal runs of hit words
    as [first, end)) and byte_spans (the same runs in the original UTF-8 text)."""
    pairs = pa.list_(pa.list_(pa.int64()))
    schema = "doc_id long, n_words long, items array<string>, word_spans array<array<long>>, byte_spans array<array<long>>"

    def scan(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = built(shared.value, n)
            for rows, buf, off in K.pieces(batches):
                before = rows.select(["items", "word_spans"]).to_pylist() if rows.num_columns > 2 else [None] * rows.num_rows
                counts, found, wspans, bspans = [], [], [], []
                for a, b, known in zip(off[:-1].tolist(), off[1:].tolist(), before, strict=True):
                    k, which, first, end = m.find(buf[a:b].tobytes())
                    counts.append(k)
                    if not len(which) and not (known and known["items"]):
                        found.append([]), wspans.append([]), bspans.append([])
                        continue
                    names, mark = set().union(*(m.owners[i] for i in np.unique(which).tolist())), np.zeros(k + 1, np.int64)
                    np.add.at(mark, first, 1)
                    np.add.at(mark, end, -1)
                    for lo, hi in known["word_spans"] if known else ():
                        mark[lo] += 1
                        mark[hi] -= 1
                    lo, hi = K.spans(np.cumsum(mark[:-1]) > 0)
                    start, stop, _ = K.words(buf[a:b], np.array([0, b - a]), K.ALNUM)
                    found.append(sorted(names.union(known["items"] if known else ())))
                    wspans.append(np.stack((lo, hi), 1).tolist())
                    bspans.append(np.stack((start[lo], stop[hi - 1]), 1).tolist())
                texts = [rows.column(rows.schema.get_field_index("text"))] if carry else []
                cols = [rows.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(wspans, pairs), pa.array(bspans, pairs), *texts]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "items", "word_spans", "byte_spans"] + ["text"] * carry)

        carry = more
        return run

    out = docs.select("doc_id", "text")
    blocks = item_blocks(items)
    now = next(blocks)
    while now is not None:
        later = next(blocks, None)
        more = later is not None
        shared = docs.sparkSession.sparkContext.broadcast(now)
        out = out.mapInArrow(scan(shared), schema + ", text string" * more)
        if more:
            out = checkpointed(out)
            shared.destroy()
        now = later
    return out


def digests(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns. The check runs beside the
    rows, without a join: columns that clash in name with the operator's are kept as they are."""

    def keep(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = built(shared.value, n)
            for rows, buf, off in K.pieces(batches):
                ok = [not len(m.find(buf[a:b].tobytes())[1]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield rows.filter(pa.array(ok, pa.bool_()))

        return run

    out, shared = docs, None
    for block in item_blocks(items):
        if shared is not None:
            out = checkpointed(out)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(keep(shared), docs.schema)
    return out


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], n: int = WINDOW) -> list[tuple]:
    """Reference for tests: compares every window with every place."""

    def split(t: str | None) -> list[bytes]:
        return (t or "").encode().translate(NORMAL).split()

    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, t in items:
            w = split(t)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                part = w[i : i + n]
                for j in range(len(words) - len(part) + 1):
                    if words[j : j + len(part)] == part:
                        found.add(str(item))
                        hit.update(range(j, j + len(part)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
