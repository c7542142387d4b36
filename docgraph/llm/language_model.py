"""Interpolated modified Kneser-Ney n-gram model of any order from 2, counted in Spark and kept as sorted hash arrays.

Words: each task sums its token hashes and sends them to word shards, which give every word a number. N-grams are then
written as numbers, so that they travel in few bytes and equality is exact.

Counting: each task sums its n-grams and sends them to shards. A shard adds up equal n-grams, and sends on, summed again,
what the words but the last have as context (how many n-grams of count 1, 2, 3 and more follow, and the sum of their counts) and how many different
words come before the words but the first. These are the counts of the next lower order, down to single words. Nothing is sampled.
N-grams of the highest order are dealt by the words in the middle, so that most of both sums is done in one shard; what has
frequent words in the middle is split by the whole n-gram, in parts that the least of their counts asks for. Lower orders go by the whole n-gram.

Storage: files in one folder of the shared checkpoint directory, for each shard: the word hashes with numbers and counts; and the n-grams of each order as sorted hashes, of which the leading bits are an index and the next 32 are kept
(an n-gram that isn't there is taken for one that is with a probability of 4e-9, at any size), with a code for their counts. Every shard has all
files, also if it is empty, and a file says how long it is: a worker that doesn't find a file whole fails, instead of taking its words for unknown ones.
Workers map shards into memory (the last `OPEN` of them) and look up a block's distinct hashes in sorted order.

Probability of w after the words x, and after x', which lacks the first of them, with discounts D1, D2, D3 of each order from its counts of counts:
    p(w|x) = max(c(x,w) - D(c), 0) / c(x) + (D1 N1(x) + D2 N2(x) + D3 N3(x)) / c(x) * p(w|x')
and p(w|x) = p(w|x') if x is no known context. c counts occurrences in the highest order, and different words before it in all others.
Below single words stands 1 / (V + 1), which leaves mass for unknown words. Texts begin with as many start tokens as a context has words.

The model's folder must be reachable by all machines as files (file:// of a shared mount).
Nulls: a null text is empty and has the end token alone. Repeated rows are counted as often as
they stand there. Empty training tables give the base 1 / (V + 1) everywhere. Further columns aren't read. A very long text is one block of its own.
`Model.delete` removes the folder, with what aborted tasks have left in it; scores that are still to be computed need it.
"""

from __future__ import annotations

import os
import struct
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import new_folder, text_bytes
from .repeats import by_group, narrow, widen

#: Hash of the end token, and the number of the token before the first word.
END, START = K.U64(0x13198A2E03707344), 0
SHARD_BYTES = 10 << 20
FLUSH_BYTES = 12 << 20
#: See train.
SPLIT = 1 << 18
#: Files that a worker keeps mapped.
OPEN = 4096
#: Codes from here on take more than a byte.
RARE = 255
#: Columns of an n-gram: its count; as context: n-grams of count 1, 2, 3 and more, sum of counts.
COLUMNS = 5
ROWS = "shard int, kind int, data binary"


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (each text's words and its end) and the first token of each text."""
    low = K.LOWER[buf]
    start, end, first = K.words(low, off, ~K.SPACE)
    n = len(off) - 1
    at = first + np.arange(n + 1)
    out = np.full(len(start) + n, END, np.uint64)
    out[np.arange(len(start)) + np.repeat(np.arange(n), np.diff(first))] = K.word_hashes(low, start, end)
    return out, at


def grams(ids: np.ndarray, first: np.ndarray, order: int, start: int = START) -> list[np.ndarray]:
    """The columns of the n-grams that end at each token: the words before it, farthest first, and itself. start: what stands before a text."""
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    out = [ids]
    for back in range(1, order):
        before = np.full(len(ids), start, np.int64)
        before[back:] = ids[: max(0, len(ids) - back)]
        before[place < back] = start
        out.insert(0, before)
    return out


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        out = K.mix(out + c.astype(np.uint64) * K.U64(0xD1B54A32D192ED03) + K.U64(1))
    return out


def home(columns: list[np.ndarray], key: np.ndarray, shards: int, counts: list[np.ndarray] | None = None, split: int = SPLIT) -> np.ndarray:
    """The shard of each n-gram. counts: how often the words in the middle occur; None in the lower orders."""
    if not counts:
        return (key % K.U64(shards)).astype(np.int64)
    parts = np.minimum.reduce(counts) // split + 1
    return ((gram_hash(columns[1:-1]) % K.U64(shards) + K.mix(key) % parts.astype(np.uint64)) % K.U64(shards)).astype(np.int64)


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by columns, and where different rows begin in it."""
    n = len(columns[0])
    bits = [int(c.max()).bit_length() if n else 0 for c in columns]
    if sum(bits) >= 64:
        # ranks keep the order, in fewer bits
        columns = list(columns)
        for k in np.argsort(bits)[::-1].tolist():
            if sum(bits) >= 64:
                known, columns[k] = np.unique(columns[k], return_inverse=True)
                bits[k] = len(known).bit_length()
    if sum(bits) < 64:
        packed = np.zeros(n, np.uint64)
        for c, b in zip(columns, bits, strict=True):
            packed = (packed << K.U64(b)) | c.astype(np.uint64)
        order = np.argsort(packed)
        packed = packed[order]
        fresh = packed[1:] != packed[:-1]
    else:
        order = np.lexsort(columns[::-1])
        fresh = np.zeros(max(0, n - 1), bool)
        for c in columns:
            x = c[order]
            fresh |= x[1:] != x[:-1]
    return order, np.flatnonzero(np.concatenate(([True], fresh))) if n else np.zeros(0, np.int64)


def add_up(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows in sorted order, and sums of their values."""
    order, head = _sorted(columns)
    sums = [np.add.reduceat(v[order], head, dtype=np.int64) if len(head) else v[:0].astype(np.int64) for v in values]
    return [c[order[head]] for c in columns], sums


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers of equal length, byte by byte, compressed."""
    small = [narrow(c) for c in columns]
    body = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in small)
    head = struct.pack(f"<{2 + len(small)}q", len(small), len(small[0]), *(c.itemsize for c in small))
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> list[np.ndarray]:
    k, n = struct.unpack_from("<2q", data)
    widths = struct.unpack_from(f"<{k}q", data, 16)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16 + 8 * k :]) if n else b"", np.uint8)
    out, at = [], 0
    for w in widths:
        out.append(np.ascontiguousarray(body[at : at + n * w].reshape(w, n).T).view(f"<u{w}").reshape(n))
        at += n * w
    return out


def _rows(shard: np.ndarray, kind: int, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    return [(s, kind, pack([c[part] for c in columns])) for s, part in by_group(shard)]


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    shard, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "data"])


def _of_kind(table: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """The columns of all packages of a kind."""
    found = [unpack(d.as_py()) for k, d in zip(table.column("kind").to_pylist(), table.column("data"), strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.uint8)] * width


class Files:
    """Arrays in the model's folder. A file: number of arrays, each array's type and length, then the arrays."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        if parts.scheme not in ("", "file"):
            raise ValueError(f"{uri}: the model is mapped into memory, so spark.checkpoint.dir must be a file:// folder on a shared mount")
        self.path = parts.path
        self.maps: OrderedDict[tuple[str, int], tuple[np.ndarray, ...]] = OrderedDict()

    def save(self, kind: str, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        """Written beside its place and renamed: a second attempt of a task replaces equal content."""
        os.makedirs(self.path, exist_ok=True)
        to = f"{self.path}/{kind}-{shard}"
        temp = f"{to}.{os.getpid()}.{os.urandom(4).hex()}"
        arrays = [keys, *(narrow(v) for v in values)]
        with open(temp, "wb") as f:
            f.write(struct.pack(f"<{1 + 2 * len(arrays)}q", len(arrays), *(x for a in arrays for x in (a.itemsize, a.size))))
            for x in arrays:
                f.write(np.ascontiguousarray(x).tobytes())
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, to)

    def load(self, kind: str, shard: int) -> tuple[np.ndarray, ...]:
        if (kind, shard) in self.maps:
            self.maps.move_to_end((kind, shard))
            return self.maps[kind, shard]
        name = f"{self.path}/{kind}-{shard}"
        if not os.path.exists(name):
            raise FileNotFoundError(f"{name}: a file of the language model is missing")
        raw = np.asarray(np.memmap(name, np.uint8, "r"))
        k = int(raw[:8].view(np.int64)[0])
        head = raw[8 : 8 + 16 * k].view(np.int64).reshape(k, 2).tolist()
        if len(raw) != 8 + 16 * k + sum(w * n for w, n in head):
            raise OSError(f"{name}: a file of the language model isn't whole")
        out, at = [], 8 + 16 * k
        for width, n in head:
            out.append(raw[at : at + n * width].view(f"<u{width}"))
            at += n * width
        self.maps[kind, shard] = tuple(out)
        if len(self.maps) > OPEN:
            self.maps.popitem(last=False)
        return tuple(out)

    def find(self, kind: str, shards: int, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """The values beside sorted distinct keys, 0 where a key isn't there."""
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        for shard, part in by_group((keys % K.U64(shards)).astype(np.int64)):
            have, *values = self.load(kind, shard)
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
                ok = have[at] == keys[part]
                for o, v in zip(out, values, strict=True):
                    o[part[ok]] = v[at[ok]]
        return out

    def save_grams(self, kind: str, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
        """N-grams by hash: an index of the leading bits, the next 32 bits of each, the code of its values, and the values of each code."""
        order = np.argsort(keys)
        keys = keys[order]
        bits = max(1, (len(keys) // 16).bit_length())
        index = np.searchsorted(keys >> K.U64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint64)
        marks = ((keys >> K.U64(32 - bits)) & K.U64(0xFFFFFFFF)).astype(np.uint32)
        kinds, code = np.zeros((0, len(values)), np.int64), np.zeros(0, np.int64)
        if len(keys):
            rows, head = _sorted(values)
            size = np.diff(np.append(head, len(rows)))
            often = np.argsort(-size, kind="stable")
            rank = np.empty(len(head), np.int64)
            rank[often] = np.arange(len(head))
            code = np.empty(len(keys), np.int64)
            code[rows] = np.repeat(rank, size)
            kinds, code = np.stack([v[rows[head[often]]] for v in values], 1), code[order]
        # the most frequent codes have a byte; the others stand apart, by place
        rare = np.flatnonzero(code >= RARE)
        self.save(kind, shard, index, marks, np.minimum(code, RARE).astype(np.uint8), rare, code[rare], kinds.ravel())

    def find_grams(self, kind: str, keys: np.ndarray, shard: np.ndarray, columns: int) -> list[np.ndarray]:
        """The values of n-grams by hash and shard, 0 for those that aren't there."""
        out = np.zeros((columns, len(keys)), np.int64)
        for s, part in by_group(shard):
            index, marks, code, rare, codes, kinds = self.load(kind, s)
            if not len(code):
                continue
            bits = (len(index) - 1).bit_length() - 1
            key = keys[part]
            bucket = (key >> K.U64(64 - bits)).astype(np.int64)
            mark = ((key >> K.U64(32 - bits)) & K.U64(0xFFFFFFFF)).astype(np.uint32)
            low, high = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
            end, last = high.copy(), len(code) - 1
            for _ in range(int((high - low).max()).bit_length()):
                mid = (low + high) >> 1
                less = (low < high) & (marks[np.minimum(mid, last)] < mark)
                low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            at = np.minimum(low, last)
            ok = (low < end) & (marks[at] == mark)
            at = at[ok]
            of = code[at].astype(np.int64)
            far = np.flatnonzero(of == RARE)
            of[far] = codes[np.searchsorted(rare, at[far])]
            out[:, part[ok]] = kinds.reshape(-1, columns)[of].T
        return list(out)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; where a count is missing, the usual bounds."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 / n2), 3 - 4 * y * (n4 / n3 if n3 else 0)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))  # type: ignore[return-value]


class Model:
    """Where the arrays are, the order, and the sums over the whole corpus."""

    def __init__(self, folder: str, shards: int, order: int, split: int, sums: dict[str, int]):
        self.folder, self.shards, self.order, self.split, self.sums = folder, shards, order, split, sums

    def delete(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _lookup(files: Files, shards: int, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (-1: unknown) and counts of tokens."""
    keys, back = np.unique(tok, return_inverse=True)
    ids, count = files.find("word", shards, keys, 2)
    return np.where(count > 0, ids, -1)[back], count[back]


def _count_words(folder: str, shards: int, docs: DataFrame) -> DataFrame:
    """Writes the words of each shard; a row of sums for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            rows = _rows((keys % K.U64(shards)).astype(np.int64), 0, [keys, n])
            yield from _table(rows).to_batches()

        for _, buf, off in K.pieces(batches):
            held.append(tokens(buf, off)[0])
            size += len(buf)
            if size >= FLUSH_BYTES:
                yield from send()
                size = 0
        if held:
            yield from send()

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _of_kind(table, 0, 2)
        own, at = np.unique(keys.astype(np.uint64), return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)
        Files(folder).save("word", shard, own, (np.arange(len(own)) + 1) * shards + shard, n)
        return pa.table({"tokens": [int(n.sum())], "vocabulary": [len(own)], "texts": [int(n[own == END].sum())]})

    counted = docs.select("text").mapInArrow(count, ROWS).unionAll(_nothing(docs.sparkSession, shards))
    return counted.groupBy("shard").applyInArrow(store, "tokens long, vocabulary long, texts long")


def _nothing(spark: SparkSession, shards: int) -> DataFrame:
    """A row without content for each shard, so that every shard writes its files."""
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(-1).alias("kind"), F.lit(b"").alias("data"))


#: Kinds of packages: n-grams with counts and of count 1, contexts with their sums and with one n-gram of count 1, and counts of counts of each order.
COUNTS, ONES, CONTEXTS, SINGLE, SUMS = 0, 1, 2, 3, 4


def _count_grams(folder: str, shards: int, order: int, texts: int, split: int, docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        held: list[list[np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            *columns, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows, head = _sorted([*columns[1:-1], columns[0], columns[-1]])
            n = np.diff(np.append(head, len(rows)))
            at = rows[head]
            one = n == 1
            yield from _table(_rows(shard[at[one]], ONES, [c[at[one]] for c in columns])).to_batches()
            yield from _table(_rows(shard[at[~one]], COUNTS, [*(c[at[~one]] for c in columns), n[~one]])).to_batches()

        for _, buf, off in K.pieces(batches):
            tok, first = tokens(buf, off)
            ids, counts = _lookup(files, shards, tok)
            columns = grams(ids, first, order)
            shard = home(columns, gram_hash(columns), shards, grams(counts, first, order, texts)[1:-1], split)
            held.append([*(narrow(c) for c in columns), shard.astype(np.int32)])
            size += len(buf)
            if size >= FLUSH_BYTES:
                yield from send()
                size = 0
        if held:
            yield from send()

    return docs.select("text").mapInArrow(count, ROWS).unionAll(_nothing(docs.sparkSession, shards))


def _received(table: pa.Table, level: int, top: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams of a shard, sorted by the words in the middle, the first and the last, and their values."""
    parts = [_of_kind(table, COUNTS, level + 1), _of_kind(table, ONES, level)]
    if not top:
        parts += [_of_kind(table, CONTEXTS, level + 4), _of_kind(table, SINGLE, level)]
    size = [len(p[0]) for p in parts]
    columns = [np.concatenate([p[c] for p in parts]) for c in range(level)]
    # of each kind: count, and as context N1, N2, N3 and more, sum
    fixed = {ONES: (1, 0, 0, 0, 0), SINGLE: (0, 1, 0, 0, 1), COUNTS: (None, 0, 0, 0, 0), CONTEXTS: (0, None, None, None, None)}
    values = []
    for v in range(1 if top else COLUMNS):
        of = []
        for kind, p in enumerate(parts):
            x = fixed[kind][v]
            of.append(p[level + (v if kind == COUNTS else v - 1)] if x is None else np.full(size[kind], x, np.uint8))
        values.append(np.concatenate(of))
    del parts
    turn = [*range(1, level - 1), 0, level - 1] if level > 1 else [0]
    sorted_columns, values = add_up([columns[c] for c in turn], values)
    out = [columns[0]] * level
    for c, x in zip(turn, sorted_columns, strict=True):
        out[c] = x
    return out, values


def _sums(table: pa.Table, level: int, order: int, counts: np.ndarray) -> np.ndarray:
    """What came in as counts of counts (a row for each order), with those of this order."""
    out = np.zeros((order, 5), np.int64)
    for x in _of_kind(table, SUMS, 1)[:1]:
        out += x.astype(np.int64).reshape(-1, order, 5).sum(0)
    out[level - 1] += np.bincount(np.minimum(counts, 5), minlength=6)[1:]
    return out


def _store_grams(folder: str, shards: int, level: int, order: int):
    """Writes a shard's n-grams and sends on what they are to the next lower order."""

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        columns, values = _received(table, level, level == order)
        Files(folder).save_grams(f"gram{level}", shard, gram_hash(columns), values)
        counts = values[0]
        sums = _sums(table, level, order, counts)
        if level < order:
            real = counts > 0
            columns, counts = [c[real] for c in columns], counts[real]
        del values, table
        rows = [(shard, -1, b""), (0, SUMS, pack([sums.ravel()]))]
        if len(counts):
            new = np.zeros(len(counts), bool)
            new[0] = True
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            head = np.flatnonzero(new)
            by = [np.add.reduceat(x, head, dtype=np.int64) for x in (counts == 1, counts == 2, counts > 2, counts)]
            context = [c[head] for c in columns[:-1]]
            to = home(context, _key(context), shards)
            one = (by[0] == 1) & (by[3] == 1)
            rows += _rows(to[one], SINGLE, [c[one] for c in context]) + _rows(to[~one], CONTEXTS, [c[~one] for c in (*context, *by)])
            order_, head = _sorted(columns[1:])
            n = np.diff(np.append(head, len(order_)))
            rest = [c[order_[head]] for c in columns[1:]]
            to = home(rest, _key(rest), shards)
            one = n == 1
            rows += _rows(to[one], ONES, [c[one] for c in rest]) + _rows(to[~one], COUNTS, [c[~one] for c in (*rest, n)])
        K.trim()
        return _table(rows)

    return store


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """Single words go by their number, n-grams by hash."""
    return columns[0].astype(np.uint64) if len(columns) == 1 else gram_hash(columns)


def _store_ones(folder: str, order: int):
    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        (ids,), values = _received(table, 1, False)
        Files(folder).save_grams("gram1", shard, gram_hash([ids]), values)
        sums = _sums(table, 1, order, values[0])
        names = [f"{k}_{j}" for k in range(1, order + 1) for j in range(1, 6)] + ["before"]
        return pa.table({"name": names, "n": [*sums.ravel().tolist(), int(values[0].sum())]})

    return store


def train(docs: DataFrame, order: int = 2, split: int = SPLIT) -> Model:
    """Counts docs (column text): words, then n-grams from the highest order down; each stage writes its arrays.

    split: n-grams of the highest order with the same words in the middle are split into parts of about so many occurrences.
    """
    if order < 2:
        raise ValueError(f"order {order}: the model has contexts, so it is at least 2")
    spark = docs.sparkSession
    folder = new_folder(spark, "kneser-ney")
    shards = int(max(8, -(-text_bytes(docs) // SHARD_BYTES)))
    words = _count_words(folder, shards, docs)
    sums = words.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("tokens", "vocabulary", "texts")]).first().asDict()
    rows = _count_grams(folder, shards, order, sums["texts"], split, docs)
    for level in range(order, 1, -1):
        rows = rows.groupBy("shard").applyInArrow(_store_grams(folder, shards, level, order), ROWS)
    summed = rows.groupBy("shard").applyInArrow(_store_ones(folder, order), "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return Model(folder, shards, order, split, sums | {r.name: r.n for r in summed.collect()})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score (log10)."""
    folder, shards, order, split, s = model.folder, model.shards, model.order, model.split, model.sums
    d = [np.array([0.0, *_discounts(*(s[f"{k}_{j}"] for j in range(1, 5)))]) for k in range(1, order + 1)]
    n, v, texts, total = s["tokens"], s["vocabulary"], s["texts"], s["before"]
    rest = (d[0][1] * s["1_1"] + d[0][2] * s["1_2"] + d[0][3] * (s["1_3"] + s["1_4"] + s["1_5"])) / total if total else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for rows, buf, off in K.pieces(batches, limit=1 << 21):
            tok, first = tokens(buf, off)
            ids, count = _lookup(files, shards, tok)
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
            columns = grams(ids, first, order)
            own, back = np.unique(np.concatenate((columns[-2], ids)), return_inverse=True)
            known = own >= 0
            ones = np.zeros((COLUMNS, len(own)), np.int64)
            ones[:, known] = np.stack(files.find_grams("gram1", gram_hash([own[known]]), own[known] % shards, COLUMNS))
            before, w = np.split(back, 2)
            c = ones[0][w]
            p = (np.maximum(c - d[0][np.minimum(c, 3)], 0) / total if total else 0.0) + rest / (v + 1)
            context = [x[before] for x in ones[1:]]
            for level in range(2, order + 1):
                gram = columns[order - level :]
                key, real = gram_hash(gram), np.logical_and.reduce([x >= 0 for x in gram])
                c, after = np.zeros(len(tok), np.int64), None
                if level == order:
                    at = home(gram, key, shards, grams(count, first, order, texts)[1:-1], split)
                    (c[real],) = files.find_grams(f"gram{level}", key[real], at[real], 1)
                else:
                    # the n-grams here, and those that are contexts in the next order
                    longer = columns[order - level - 1 : -1]
                    real = np.concatenate((real, np.logical_and.reduce([x >= 0 for x in longer])))
                    keys, back = np.unique(np.concatenate((key, gram_hash(longer)))[real], return_inverse=True)
                    found = np.zeros((COLUMNS, len(real)), np.int64)
                    found[:, real] = np.stack(files.find_grams(f"gram{level}", keys, home([], keys, shards), COLUMNS))[:, back]
                    c, after = found[0, : len(tok)], list(found[1:, len(tok) :])
                n1, n2, n3, of = context
                gamma = d[level - 1][1] * n1 + d[level - 1][2] * n2 + d[level - 1][3] * n3
                den = np.maximum(of, 1)
                p = np.where(of > 0, np.maximum(c - d[level - 1][np.minimum(c, 3)], 0) / den + gamma / den * p, p)
                context = after
            add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first)), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
