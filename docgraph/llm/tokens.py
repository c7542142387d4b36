"""Exact token ids and counts by public tokenizers, with one encoding per distinct chunk of text.

A chunk is a run of ASCII white space together with what follows up to the next run; sentence
punctuation after an ASCII letter starts another chunk. The tokenizers here never join across these
places, so the ids of a text are those of its chunks in order; a cut is made only after an ASCII
character. Each worker encodes a chunk once and keeps its ids
in a table; when that has grown to `MAX_CHUNKS`, what was seen once is dropped. Ids never depend on what is kept.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from . import kernels as K

MAX_CHUNKS = 500_000


STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def chunks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of a block; first chunk of each text (n + 1 numbers)."""
    space = K.SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        cut[1:-1] = (space[1:] & ~space[:-1] & (buf[:-1] < 128)) | (STOP[buf[1:]] & LETTER[buf[:-1]])
    cut[off] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(buf))
    return start, end, np.searchsorted(start, off)


class Encoder:
    """Ids of texts. encode_batch takes a list of texts and returns their numbers of ids and all ids."""

    def __init__(self, encode_batch: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], folds: bool = False):
        """folds: the tokenizer lower-cases, so chunks without "<" (special tokens) that differ in case only share an entry."""
        self.encode_batch, self.folds = encode_batch, folds
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # whether a key was seen in a later block too

    def _forget(self) -> None:
        """Drops what was seen in one block only; most chunks of a text are seen never again."""
        keep = self.again
        if 2 * keep.sum() > MAX_CHUNKS:
            self._clear()
            return
        slot = self.slot[keep]
        size = self.start[slot + 1] - self.start[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        self.ids = self.ids[np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])]
        self.keys, self.slot, self.start = self.keys[keep], np.arange(len(slot)), total
        self.again = np.zeros(len(slot), bool)

    def _learn(self, texts: list[str], keys: np.ndarray, at: np.ndarray) -> None:
        sizes, ids = self.encode_batch(texts)
        slots = np.arange(len(texts)) + len(self.start) - 1
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))
        self.keys, self.slot, self.again = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots), np.insert(self.again, at, False)

    def _slots(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each chunk; learns what is new."""
        hashes = K.word_hashes(buf, start, end)
        if self.folds:
            marks = np.concatenate(([0], np.cumsum(buf == 60)))
            hashes = np.where(marks[end] == marks[start], K.word_hashes(K.LOWER[buf], start, end), hashes)
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(own) > MAX_CHUNKS:
            self._forget()
        at = np.searchsorted(self.keys, own)
        new = np.ones(len(own), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != own
        self.again[at[~new]] = True
        if new.any():
            pick, raw = first[new], buf.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
            self._learn(texts, own[new], at[new])
            at = np.searchsorted(self.keys, own)
        return self.slot[at][back]

    def counts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of ids of each chunk."""
        slot = self._slots(buf, start, end)
        return self.start[slot + 1] - self.start[slot]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a block and their offsets."""
        start, end, first = chunks(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        slot = self._slots(buf, start, end)
        begin, size = self.start[slot], self.start[slot + 1] - self.start[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(begin - total[:-1], size) + np.arange(total[-1])
        return self.ids[take], total[first]


def flat(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    return sizes, np.fromiter((x for g in got for x in g), np.uint32, int(sizes.sum()))


class WordEndBatch:
    """Batches for a tokenizer whose vocabulary marks the ends of words: chunks of letters only are one word each,
    so many are encoded as one text and cut where a word ends. Whatever doesn't fit that is encoded by itself."""

    def __init__(self, tokenizer: object, suffix: str):
        self.tokenizer = tokenizer
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for word, i in tokenizer.get_vocab().items() if word.endswith(suffix)]] = True

    def single(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bare = [t.strip(" \t\n\r\v\f") for t in texts]
        is_word = np.fromiter((t.isalpha() for t in bare), bool, len(bare))
        plain = np.flatnonzero(is_word)
        groups = [[bare[i] for i in part] for part in np.array_split(plain, len(plain) // 128 + 1)]
        ids = np.fromiter((x for g in self.single([" ".join(g) for g in groups]) for x in g), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(plain) or len(ids) and last[-1] != len(ids) - 1:
            return flat(self.single(texts))
        other = np.flatnonzero(~is_word)
        other_sizes, other_ids = flat(self.single([texts[i] for i in other]))
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain], sizes[other] = np.diff(last, prepend=-1), other_sizes
        owner = np.repeat(is_word, sizes)
        out = np.zeros(int(sizes.sum()), np.uint32)
        out[owner], out[~owner] = ids, other_ids
        return sizes, out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a lower-casing tokenizers JSON file with word ends, one in each worker process. Strings of special tokens
    in a text are encoded as the library's default does."""
    if path not in _encoders:
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        kinds = [n.get("type") for n in (model.get("normalizer") or {}).get("normalizers", [])]
        suffix = model["model"].get("end_of_word_suffix")
        t = Tokenizer.from_file(path)
        batch = WordEndBatch(t, suffix) if suffix else lambda texts: flat([e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])
        _encoders[path] = Encoder(batch, folds="Lowercase" in kinds)
    return _encoders[path]
