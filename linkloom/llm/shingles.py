"""Hashed word shingles of whole texts, a slice of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from linkloom.llm import arrow

#: Words a Python worker remembers the hash of.
MEMO_WORDS = 200_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Hashes()
arrow.at_task_end(_memo.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def lower_words(text: str) -> list[bytes]:
    """Words between white space, with A-Z in lower case; bytes methods touch nothing but ASCII."""
    return text.encode().lower().split()


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, which depends on their order."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, np.uint64(n))
    for i in range(n):
        out = mix(out * _GOLD + hashes[i : i + count])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by sorting: ``np.unique`` fills a hash table, which takes ten times as long from 3,000 values on."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """The sorted distinct hashes of all ``n``-word shingles; a shorter text is one shingle, one without words none."""
    if not words:
        return np.zeros(0, np.uint64)
    return distinct(windows(word_hashes(words), min(n, len(words))))
