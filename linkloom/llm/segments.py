"""Byte-level BPE over segments: a text is cut only where the split pattern always cuts.

The public pattern ends a piece before every space that follows a character
which is not white space. A text cut there is a list of segments whose tokens
don't depend on each other, so each distinct segment is encoded once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from linkloom.llm import arrow, shingles

_CUT = re.compile(r"(?<=\S) ")
_SPACES = re.compile(r"\s\s|\A\s")
#: Distinct segments that are encoded as one text.
JOINED = 512
#: Segments a Python worker remembers; the memo starts anew beyond that.
MEMO_SEGMENTS = 120_000
#: The same where their hashes are remembered instead.
LIBRARY_SEGMENTS = 1_000_000


def segments(text: str) -> list[str]:
    """The text's segments in order; joined they are the text."""
    if not text:
        return []
    first, *rest = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
    return [first, *[" " + x for x in rest]]


def joined(parts: list[str]) -> list[str]:
    """The parts in order as few texts, joined only where the pattern cuts anyway."""
    edges = {k for k, p in enumerate(parts) if p[0] != " "} | {k + 1 for k, p in enumerate(parts) if p[-1].isspace()}
    cuts = sorted(edges | set(range(0, len(parts), JOINED)) | {len(parts)})
    return ["".join(parts[a:b]) for a, b in zip(cuts, cuts[1:])]


class _Index(dict):
    """Segment to number, with the segments first met since the last look."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class SegmentEncoder:
    """Encodes texts through ``encode(segments) -> (all ids, ids of each segment)``, once for each distinct segment."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_SEGMENTS) -> None:
        self._encode, self._limit = encode, limit
        self._reset()
        arrow.at_task_end(self._reset)

    def _reset(self) -> None:
        self.index = _Index()
        self.lens, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Each segment's number in the memo; its ids are ``pool[starts[n] : starts[n] + lens[n]]``."""
        if len(self.index) > self._limit:
            self._reset()
        found = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        if self.index.fresh:
            ids, lens = self._encode(self.index.fresh)
            self.index.fresh = []
            self.lens, self.pool = np.concatenate([self.lens, lens]), np.concatenate([self.pool, ids])
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids start (one more entry than texts)."""
        cut = [segments(t) for t in texts]
        numbers = self.numbers([s for x in cut for s in x])
        lens = self.lens[numbers]
        starts = np.concatenate([[0], np.cumsum(self.lens)])[numbers]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(starts - (ends - lens), lens) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[bounds]


def byte_cuts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where segments start in the bytes of texts that start at ``texts``: as :func:`segments`, or fewer cuts.

    No cut is made after a character of three bytes that might be white space.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    before = data[at - 1]
    good = (before > 32) & (before != 127)
    wide = before >= 128
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    good &= ~(wide & (two == 0xC2) & ((before == 0x85) | (before == 0xA0)))
    good &= ~(wide & (three >= 0xE1) & (three <= 0xE3) & (two >= 0x80))
    cut = np.zeros(len(data), bool)
    cut[at[good]] = True
    cut[texts[texts < len(data)]] = True
    return np.flatnonzero(cut)


class HashedEncoder:
    """Like :class:`SegmentEncoder`, with the memo's keys hashed by words of eight bytes.

    A key is two chains of mixed words that start from the length: two segments
    of one length up to eight bytes never have the same key, others about once
    in 2^128. The memo holds numbers only, a sixth of what strings take.
    """

    #: Bytes of a word, and the longest segment that is hashed so.
    WORD, LONGEST = 8, 2048
    _SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
    _ODD = np.array([0xA4093822299F31D1, 0x082EFA98EC4E6C89], np.uint64)

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int) -> None:
        self._encode, self._limit = encode, limit
        self._reset()  # the memo outlives tasks: it takes 45 MB at most

    def _reset(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lens, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _hashes(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ndarray(len(raw), "<u8", raw + bytes(self.WORD), strides=(1,))  # the word at each byte
        out = [shingles.mix(seed ^ sizes.astype(np.uint64)) for seed in self._SEEDS]
        long = sizes > self.LONGEST
        left = np.flatnonzero(~long)
        at = 0
        while len(left):
            rest = np.minimum(sizes[left] - at, self.WORD).astype(np.uint64)
            word = words[starts[left] + at] & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - rest * np.uint64(8)))
            for k in range(2):
                out[k][left] = shingles.mix(out[k][left] * self._ODD[k] ^ word)
            at += self.WORD
            left = left[sizes[left] > at]
        for i in np.flatnonzero(long).tolist():
            digest = xxhash.xxh3_128_intdigest(raw[starts[i] : starts[i] + sizes[i]])
            out[0][i], out[1][i] = digest >> 64, digest & ((1 << 64) - 1)
        return out[0], out[1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids start (one more entry than texts)."""
        raws = [t.encode() for t in texts]
        raw = b"".join(raws)
        data, bounds = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, raws)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = byte_cuts(data, bounds[:-1])
        sizes = np.diff(starts, append=len(data))
        key, check = self._hashes(raw, starts, sizes)
        found, first, place = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > self._limit:
            self._reset()
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        known = (self.keys[at] == found) if len(self.keys) else np.zeros(len(found), bool)
        if (~known).any():
            new = first[~known]
            ids, lens = self._encode([raw[a:b].decode() for a, b in zip(starts[new].tolist(), (starts[new] + sizes[new]).tolist())])
            where = np.searchsorted(self.keys, found[~known])
            own = len(self.pool) + np.cumsum(lens) - lens
            self.keys, self.checks = np.insert(self.keys, where, found[~known]), np.insert(self.checks, where, check[new])
            self.starts, self.lens = np.insert(self.starts, where, own), np.insert(self.lens, where, lens)
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.keys, found)
        at = at[place]
        if (self.checks[at] != check).any():  # two segments with one key: neither is looked up
            return self._plain(texts)
        lens, ends = self.lens[at], np.cumsum(self.lens[at])
        ids = self.pool[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [segments(t) for t in texts]
        ids, lens = self._encode([s for x in parts for s in x])
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *map(len, parts)])]


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    sizes = np.zeros(max(tokenizer.get_vocab().values()) + 1, np.int64)
    for token, n in tokenizer.get_vocab().items():
        sizes[n] = len(token)  # the vocabulary writes each byte as one character
    for n, token in tokenizer.get_added_tokens_decoder().items():
        if " " in token.content or token.lstrip or token.rstrip or token.single_word:
            raise ValueError(f"{path}: texts can't be cut at spaces, the string {token.content!r} may take them")
        sizes[n] = len(token.content.encode())  # these are written as they are
    return tokenizer, sizes


def token_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id of a tokenizers vocabulary, added ones included, stands for."""
    return _library(path)[1]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> HashedEncoder:
    """By the tokenizers library and a vocabulary file of it, with ``add_special_tokens=False``.

    As the library does by default, a special token's string in a text is that
    token; it has no space, so no cut is made inside it.
    """
    tokenizer, sizes = _library(path)

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = tokenizer.encode_batch_fast(joined(parts), add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in coded])
        ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(x.encode()) for x in parts])) + 1
        return ids, np.diff(ends, prepend=0)

    return HashedEncoder(encode, LIBRARY_SEGMENTS)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def ids_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Flat ids and bounds as a list column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
