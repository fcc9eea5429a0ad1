"""Hashed word n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Distinct words whose hashes a worker keeps; beyond, it starts afresh.
KEPT_WORDS = 500_000


class WordCodes(dict):
    """64-bit codes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


def coded(texts: list[bytes | None], words_of: Callable[[bytes | None], list[bytes]], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of the texts one after another, and the number of each word's text."""
    words = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    return flat, np.repeat(np.arange(len(words)), lengths)


def grams(codes: np.ndarray, owner: np.ndarray, gap: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of ``bits`` bits, and owners, of single words (gap 0) or of pairs of words ``gap`` apart within a text."""
    if gap == 0:
        return (mixed(codes) >> np.uint64(64 - bits)).astype(np.int64), owner
    if len(codes) <= gap:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = owner[gap:] == owner[:-gap]
    h = mixed(codes[:-gap] * A + codes[gap:] * B + np.uint64(gap))
    return (h >> np.uint64(64 - bits)).astype(np.int64)[same], owner[gap:][same]


#: Bytes that are hashed at a time.
CHUNK = 1 << 20
#: Longer words are hashed one by one: in a power sum modulo 2^64 very long ones could be built to collide.
LONG_WORD = 128
ROOT = int(A) | 5
CODE_OF_BYTE = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
CODE_OF_BYTE[32] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of ROOT and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, r in enumerate((ROOT, pow(ROOT, -1, 1 << 64))):
            x = np.full(1 << (n - 1).bit_length(), r, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def word_hashes(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes, the same in every process, of all words of the texts one after another, and each text's number of words.

    ``table`` translates bytes first; it makes blanks of all that parts words."""
    data = b" ".join([t or b"" for t in texts]).translate(table) + b" "
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = data.find(b" ", min(at + CHUNK, len(data) - 1)) + 1
        x = np.frombuffer(data, np.uint8, end - at, at)
        word = x != 32
        begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if word[0]:
            begin = np.concatenate([[0], begin])
        if len(begin):
            up, down = _powers_to(len(x))
            h = np.add.reduceat(CODE_OF_BYTE[x] * up[: len(x)], begin) * down[begin]
            for k in np.flatnonzero(np.diff(begin, append=len(x)) > LONG_WORD).tolist():
                w = data[at + begin[k] : data.find(b" ", at + begin[k])]
                if len(w) > LONG_WORD:
                    h[k] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
            begins.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), ends), prepend=0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C
    return (x ^ (x >> np.uint64(29))) * A


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
