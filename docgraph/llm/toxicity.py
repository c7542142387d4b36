"""Toxicity by compression distance with two zstandard dictionaries.

Training: of labelled texts, fragments (4 to 9 bytes of words) are ranked by how much more often
they stand in words of one class than of the other. The best, chosen greedily by what they add, are the content of
that class's zstandard dictionary; the library's own trainer picks what is frequent in both classes and so tells nothing. Both
dictionaries have one size and share a carrier string.

Scoring: a window is one word between a carrier, which both dictionaries hold, and a tail that none
holds, so a window's two compressed lengths differ only by what the dictionaries know of the word. (zstd finds no match
that starts in a block's last 8 bytes: hence the tail.) A word of more than `LONG` bytes, such as a text without white space, becomes
windows of `PART` bytes that hold every fragment whole: about the size of a word, so that counts and shares compare with those of other
texts, and the dictionaries stay in zstd's window. The advantage is the length with the
ordinary dictionary less the length with the toxic one. A text's features are how many of its
windows reach each of the `LEVELS` of advantage, in either direction, alone and by the number of windows; a logistic
model on the other half of the sample turns them into a probability at the classes' true frequency.

The sample is bounded: at most `SAMPLE` texts and `SAMPLE_BYTES` of each class, chosen by a hash of doc_id among the
labelled training rows; of rows with one doc_id it holds the smallest text. Texts are whole, in training and in scoring. Labels, language, source and
doc_id are not inputs of a score.

Nulls: a null or wordless text has no windows and gets the score of such texts. Rows of labels without a value aren't
used; several labels of one document count each. With no rows of one class, all scores are the share
of toxic rows (0 without labels). A very long text is scored whole, as one block. Empty tables give empty results; columns beyond doc_id, text and toxic are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE = 2000
#: Bytes of the sample of a class; texts of more than a 64th of that aren't trained on (but scored).
SAMPLE_BYTES = 16 << 20
CARRIER = bytes(range(128, 152))
TAIL = bytes(range(200, 212))
FRAGMENTS = range(4, 10)
#: Words of more bytes become windows of PART bytes, of which neighbours share SHARED: the longest fragment less one.
LONG = 64
PART = 32
SHARED = FRAGMENTS[-1] - 1
#: Bound of a dictionary's content, which must fit zstd's window beside a word.
DICT_BYTES = 3000
#: Least log odds times root of count of a fragment, in the limit of many texts.
SIGNIFICANT = 14.0
#: Least share of a class's texts with a fragment.
SHARE = 0.01
LEVELS = (1, 2, 3, 4, 5, 6)
CACHE = 500_000
THRESHOLD = 0.3


def _text_block(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


class _Words:
    """The distinct words of some texts between spaces, and in how many texts each stands."""

    def __init__(self, texts: list[str | None]):
        buf, off = _text_block(texts)
        low = K.LOWER[buf]
        start, end, first = K.words(low, off, ~K.SPACE)
        owner = np.repeat(np.arange(len(texts)), np.diff(first)).astype(np.uint64)
        h = K.word_hashes(low, start, end)
        _, one = np.unique(K.mix(h + owner * K.U64(0x9E3779B97F4A7C15)), return_index=True)
        _, at, self.weight = np.unique(h[one], return_index=True, return_counts=True)
        a, size = start[one][at], (end - start)[one][at]
        joined = np.full(int((size + 2).sum()), 32, np.uint8)
        begin, before, inner = np.cumsum(size + 2) - size - 2, np.cumsum(size) - size, np.arange(int(size.sum()))
        joined[np.repeat(begin + 1 - before, size) + inner] = low[np.repeat(a - before, size) + inner]
        self.pre = K.prefix(K.BYTE[joined], K.BASE)
        self.stop, self.word = np.repeat(begin + size + 2, size + 2), np.repeat(np.arange(len(size)), size + 2)
        self.raw, self.n = joined.tobytes(), len(texts)

    def fragments(self, n: int) -> tuple[np.ndarray, ...]:
        """Hashes of the fragments of n bytes (sorted), in how many (text, word) pairs and where each stands; each occurrence's fragment and word."""
        p = np.flatnonzero(np.arange(len(self.stop)) + n <= self.stop)
        keys, place, back = np.unique(K.ranges(self.pre, p, p + n, K.BASE), return_index=True, return_inverse=True)
        word = self.word[p]
        return keys, np.bincount(back, weights=self.weight[word], minlength=len(keys)), p[place], back, word


def _candidates(mine: _Words, a: tuple, other: _Words, b: tuple, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of n bytes that tell mine from the other: texts, counts in the other, and (fragment, word) pairs."""
    keys, count, place, back, word = a
    c2 = np.append(b[1], 0)[np.where(among(keys, b[0]), np.searchsorted(b[0], keys), len(b[0]))]
    good = np.flatnonzero(_value(count, mine.n, c2, other.n) > _least(mine.n))
    number = np.full(len(keys), -1, np.int64)
    number[good] = np.arange(len(good))
    pairs = np.flatnonzero(number[back] >= 0)
    return [mine.raw[p : p + n] for p in place[good].tolist()], c2[good], number[back[pairs]], word[pairs]


def _choose(mine: _Words, n_other: int, found: list[tuple]) -> bytes:
    """Content of a dictionary, the best last. The best is taken again and again; words that hold a chosen fragment no longer count for others."""
    texts = [t for f in found for t in f[0]]
    base = np.cumsum([0, *(len(f[0]) for f in found)])
    c2, words = np.concatenate([f[1] for f in found]).astype(np.float64), np.concatenate([f[3] for f in found])
    frags = np.concatenate([f[2] + b for f, b in zip(found, base[:-1], strict=True)])
    if len(frags):
        frags, words = np.unique(np.stack((frags, words)), axis=1)
    sizes = np.array([len(t) for t in texts])
    left, out, room = mine.weight.astype(np.float64), [], DICT_BYTES
    while len(texts):
        value = _value(np.bincount(frags, weights=left[words], minlength=len(texts)), mine.n, c2, n_other)
        gain = np.where(value > _least(mine.n), value * (sizes - 2.5), 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        if len(texts[k]) > room:
            c2[k] = mine.n * 1e9  # a shorter one may fit
            continue
        out.append(texts[k])
        room -= len(texts[k])
        left[words[frags == k]] = 0
    return b"".join(reversed(out))


def _contents(toxic: list[str | None], ordinary: list[str | None]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries; one length of fragments at a time is in memory."""
    a, b = _Words(toxic), _Words(ordinary)
    of_a, of_b = [], []
    for n in FRAGMENTS:
        x, y = a.fragments(n), b.fragments(n)
        of_a.append(_candidates(a, x, b, y, n))
        of_b.append(_candidates(b, y, a, x, n))
    return _choose(a, b.n, of_a), _choose(b, a.n, of_b)


def _least(n: int) -> float:
    """Least value of a fragment: few texts can't reach what many can."""
    return SIGNIFICANT * n / (n + 10)


def _value(count: np.ndarray, n: int, other: np.ndarray, n_other: int) -> np.ndarray:
    odds = np.log((count + 0.5) / n) - np.log((other + 0.5) / n_other)
    return np.where((count >= np.maximum(4, SHARE * n)) & (odds > 1.5), odds * np.sqrt(count), 0)


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def split(low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words as windows; words of more than `LONG` bytes are cut between characters. Starts, ends, whether a window is cut at its start (1) and end (2), the first window of each text."""
    size = end - start
    if not len(size) or size.max() <= LONG:
        return start, end, np.zeros(len(start), np.uint8), first
    step = PART - SHARED
    parts = np.where(size > LONG, -(-(size - SHARED) // step), 1)
    begin = np.concatenate(([0], np.cumsum(parts)))
    word = np.repeat(np.arange(len(size)), parts)
    a = start[word] + (np.arange(begin[-1]) - begin[word]) * step
    b = np.where(size[word] > LONG, np.minimum(a + PART, end[word]), end[word])
    for _ in range(3):
        a = a - (low[a] & 0xC0 == 0x80) * (a > start[word])
        b = b + (low[np.minimum(b, len(low) - 1)] & 0xC0 == 0x80) * (b < end[word])
    return a, b, ((a > start[word]) + 2 * (b < end[word])).astype(np.uint8), begin[first]


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes):
        n = max(len(toxic), len(ordinary))
        self.content = tuple(x.rjust(n, b"\0") + CARRIER for x in (ordinary, toxic))
        self.weights, self.prior = np.zeros(0), 0.0
        self.mean = self.scale = np.zeros(0)
        self._tools: tuple | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_tools", "_keys", "_known")} | {"_tools": None}

    def _lengths(self, segments: zstd.BufferWithSegments, n: int, which: int) -> np.ndarray:
        if self._tools is None:
            params = zstd.ZstdCompressionParameters(
                window_log=12, hash_log=12, chain_log=12, search_log=4, min_match=4, target_length=32, strategy=zstd.STRATEGY_GREEDY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            self._tools = tuple(zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT)) for c in self.content)
            self._keys, self._known = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        return np.fromiter(map(len, self._tools[which].multi_compress_to_buffer(segments, threads=1)), np.int64, n)

    def _measure(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, cut: np.ndarray) -> np.ndarray:
        size = end - start
        full = size + 2 + len(CARRIER) + len(TAIL)
        to = np.cumsum(full)
        out = np.full(int(to[-1]), 32, np.uint8)
        at = to - full
        for i, b in enumerate(CARRIER):
            out[at + i] = b
        for i, b in enumerate(TAIL):
            out[to - len(TAIL) + i] = b
        inner = np.arange(int(size.sum()))
        before = np.cumsum(size) - size
        out[np.repeat(at + len(CARRIER) + 1 - before, size) + inner] = low[np.repeat(start - before, size) + inner]
        # no fragment begins or ends at a cut
        out[at[cut & 1 > 0] + len(CARRIER)] = 255
        out[to[cut & 2 > 0] - len(TAIL) - 1] = 255
        segments = zstd.BufferWithSegments(out.tobytes(), np.stack((at, full), 1).astype("<u8").tobytes())
        return np.clip(self._lengths(segments, len(start), 0) - self._lengths(segments, len(start), 1), -100, 100).astype(np.int8)

    def advantages(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every window of a block, and the first window of each text. A worker measures a window once and keeps the result for a while."""
        low = K.LOWER[buf]
        start, end, cut, first = split(low, *K.words(low, off, ~K.SPACE))
        if not len(start):
            return np.zeros(0, np.int8), first
        if self._tools is None:
            self._measure(low, start[:1], end[:1], cut[:1])
        own, at, back = np.unique(K.word_hashes(low, start, end) ^ cut, return_index=True, return_inverse=True)
        if len(self._keys) + len(own) > CACHE:
            self._keys, self._known = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        new = ~among(own, self._keys)
        if new.any():
            where = np.searchsorted(self._keys, own[new])
            got = self._measure(low, start[at[new]], end[at[new]], cut[at[new]])
            self._keys, self._known = np.insert(self._keys, where, own[new]), np.insert(self._known, where, got)
        return self._known[np.searchsorted(self._keys, own)][back], first

    def features(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        gain, first = self.advantages(buf, off)
        n = np.diff(first)
        cols = []
        for level in LEVELS:
            for reached in (gain >= level, gain <= -level):
                total = np.concatenate(([0], np.cumsum(reached)))
                count = total[first[1:]] - total[first[:-1]]
                cols += [np.log1p(count), np.minimum(count, 3), np.log1p(1000 * count / np.maximum(n, 1))]
        return np.stack(cols, 1).astype(np.float64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 0.5)
        ridge[0] = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge + 1e-9)
            step = np.linalg.solve(hess, z.T @ (weight * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(off) - 1, self.prior)
        x = (self.features(buf, off) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def train_texts(toxic: list[str | None], ordinary: list[str | None], n_toxic: int, n_ordinary: int) -> Model:
    """Dictionaries from the even half of either list, calibration on the odd half; the numbers are those of all labelled rows."""
    if not toxic or not ordinary:
        model = Model(b"", b"")
        model.prior = n_toxic / max(1, n_toxic + n_ordinary)
        return model
    lists = [list(dict.fromkeys(x[::2])) for x in (toxic, ordinary)]
    model = Model(*_contents(*lists))
    rest = [x[1::2] or x for x in (toxic, ordinary)]
    x = np.concatenate([model.features(*_text_block(part[i : i + 100])) for part in rest for i in range(0, len(part), 100)])
    y = np.repeat([1.0, 0.0], [len(part) for part in rest])
    weight = np.repeat([n_toxic / len(rest[0]), n_ordinary / len(rest[1])], [len(part) for part in rest])
    model.fit(x, y, weight * len(x) / weight.sum())
    return model


def train(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> Model:
    """A model from the rows of labels (doc_id, toxic) that meet `use`, at most `sample` of each class."""
    known = labels.where(use).where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = []
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    for kind in (1, 0):
        ids = known.where(F.col("toxic") == kind).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        # at most `sample` ids: a bounded broadcast; of rows with one doc_id one text, so halves don't depend on their order
        rows = docs.select("doc_id", "text").where(size <= SAMPLE_BYTES // 64).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        so_far = F.sum(size).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over at most `sample` rows
        texts.append([r["text"] for r in rows.withColumn("h", F.xxhash64("doc_id")).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).orderBy("h", "doc_id").select("text").collect()])
    return train_texts(*texts, count.get(1, 0), count.get(0, 0))


_live: Model | None = None


def live(model: Model) -> Model:
    """A worker's own model with its measured words; it keeps one."""
    global _live
    if _live is None or _live.content != model.content or not np.array_equal(_live.weights, model.weights) or _live.prior != model.prior:
        _live = model
    return _live


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.pieces(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(live(model).scores(buf, off))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose score is under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.pieces(batches):
            yield rows.filter(pa.array(live(model).scores(buf, off) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str, folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
