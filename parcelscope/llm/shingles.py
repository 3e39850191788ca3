"""Multisets of word shingles as hashed arrays, for many texts at once."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from parcelscope.llm.common import mix64

#: Bits of a shingle's hash; the rest of a sort key holds the text's number.
BITS = 44
KEPT_WORDS = 150_000
FOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word's bytes; a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value
        return value


def shingles(texts: list[str], size: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, shingle, count), sorted, of words ``[^\\x20\\x09-\\x0D]+``.

    A text with fewer than ``size`` words has one shingle of all its words; one without words has none.
    """
    words = [t.encode().split() for t in texts]  # splits bytes at exactly these six characters
    lengths = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        rolled[:n - k] = rolled[:n - k] * FOLD + mix64(hashes[k:] + np.uint64(k + 1))
    text = np.repeat(np.arange(len(texts)), lengths)
    whole = np.arange(n) + size <= ends[text] if n else np.zeros(0, bool)
    values, owner = mix64(rolled[whole]), text[whole]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        few = [xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=size) for i in short.tolist()]
        values, owner = np.append(values, np.array(few, np.uint64)), np.append(owner, short)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | (values >> np.uint64(64 - BITS)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(BITS)).astype(np.int64), keys & np.uint64((1 << BITS) - 1), counts


def overlaps(first: list[str], second: list[str], size: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of texts the sums of the least and of the greatest counts of every shingle."""
    a, x, c = shingles(first, size, known)
    b, y, d = shingles(second, size, known)
    left, right = a.astype(np.uint64) << np.uint64(BITS) | x, b.astype(np.uint64) << np.uint64(BITS) | y
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    least = np.bincount(a[i], np.minimum(c[i], d[j]), len(first))
    total = np.bincount(a, c, len(first)) + np.bincount(b, d, len(first))
    return least.astype(np.int64), (total - least).astype(np.int64)
