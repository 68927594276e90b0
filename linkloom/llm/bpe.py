"""Byte-level BPE by merge replay over a corpus of distinct pieces.

All distinct pieces of a slice of the corpus are laid out as one row of tokens.
An index holds, for each pair of neighbours that some merge joins, the positions
where it stands. Merges are applied in rank order, each to all its positions at
once, and only the touched neighbours are looked up and indexed again.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linkloom.llm import arrow, segments

_NONE = np.int64(1) << 40
#: Text whose new segments are merged together; each byte of them takes about a hundred bytes meanwhile.
SLICE_BYTES = 2 << 20


class MergeTable:
    """Every pair of tokens whose bytes together are a token, with that token's rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, or a number above all ranks."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE) if len(self._keys) else np.full(len(keys), _NONE)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, by its lowest-ranked pair again and again, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == _NONE:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]


def replay(pieces: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, and the number of ids of each."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    token = table.single[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(token)
    if not n:
        return np.zeros(0, np.uint32), sizes
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    rank = np.full(n, _NONE)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = table.lookup(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    odd: list[np.ndarray] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> list[int]:
        """Indexes positions under their ranks; the ranks that are new to the index."""
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        new = []
        for r, a, b in zip(ranks[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(ranks)]):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                new.append(r)
        return new

    some = inner[rank[inner] < _NONE]
    heap = add(some, rank[some]) if len(some) else []
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            right = after[at]
            if (right[:-1] == at[1:]).any():  # a run of one token: pairs from the left, none sharing a position
                taken, skip = [], -1
                for p, q in zip(at.tolist(), right.tolist()):
                    if p != skip:
                        taken.append(p)
                        skip = q
                    else:
                        skip = -1
                at = np.array(taken)
        gone = after[at]
        beyond = after[gone]
        token[at] = r
        rank[gone] = _NONE
        token[gone] = -1
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        rank[at] = _NONE
        left = before[at]
        touched = np.concatenate([at[has], left[left >= 0]])
        if len(touched):
            fresh = table.lookup(token[touched], token[after[touched]])
            rank[touched] = fresh
            if (fresh <= r).any():
                odd.append(touched[fresh <= r])
            some = touched[fresh < _NONE]
            if len(some):
                for x in add(some, rank[some]):
                    heapq.heappush(heap, x)
    alive = token >= 0
    counts = np.diff(np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], np.cumsum(sizes)])])
    ids = token[alive].astype(np.uint32)
    if odd:  # a merge made a pair of lower rank: rank order over all positions may differ from a piece's own order
        where = np.unique(np.searchsorted(np.cumsum(sizes), np.concatenate(odd), "right"))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in where.tolist():
            parts[k] = np.array(table.one(pieces[k]), np.uint32)
            counts[k] = len(parts[k])
        ids = np.concatenate(parts)
    return ids, counts


class Codec(segments.SegmentEncoder):
    """Encodes and decodes texts; ``decimal`` and ``decoded`` hold each known segment's ids as text and its bytes."""

    def __init__(self, table: MergeTable, pattern: str, limit: int = segments.MEMO_SEGMENTS) -> None:
        self.table, self._pattern = table, regex.compile(pattern)
        super().__init__(self._merge, limit)

    def _reset(self) -> None:
        super()._reset()
        self.decimal: list[str] = []
        self.decoded: list[bytes] = []

    def _merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [p.encode() for text in segments.joined(parts) for p in self._pattern.findall(text)]
        distinct: dict[bytes, int] = {}
        number = np.fromiter((distinct.setdefault(p, len(distinct)) for p in pieces), np.int64, len(pieces))
        flat, counts = replay(list(distinct), self.table)
        lens = counts[number]
        starts = (np.cumsum(counts) - counts)[number]
        stops = np.cumsum(lens)
        ids = flat[np.repeat(starts - (stops - lens), lens) + np.arange(stops[-1] if len(stops) else 0)]
        bytes_done = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(bytes_done, np.cumsum([len(p.encode()) for p in parts]))
        lens = np.diff(stops[last], prepend=0)
        values, at, vocabulary = ids.tolist(), 0, self.table.bytes
        for k in lens.tolist():
            own = values[at : at + k]
            at += k
            self.decimal.append(",".join(map(str, own)))
            self.decoded.append(b"".join([vocabulary[i] for i in own]))
        return ids, lens


@lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(MergeTable(segments.ranks(rank_file)), pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text; a null text is empty, an empty text has no ids. Nothing is shuffled."""
    rows = arrow.base(docs, id_col, text_col)
    schema = arrow.struct(rows, ["doc_id"], "ids array<int>")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = codec(rank_file, pattern).encode(arrow.texts(batch))
        return pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id"), segments.ids_column(ids, bounds)], names=schema.fieldNames())

    return arrow.map_text(rows, of_slice, schema, limit=SLICE_BYTES)


def decode(tokens: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded binary``: the bytes that the ids stand for; null ids are none."""
    rows = tokens.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids")
    schema = arrow.struct(rows, ["doc_id"], "decoded binary")

    def run(batches):
        vocabulary = codec_bytes(rank_file)
        for batch in batches:
            out = [b"".join([vocabulary[i] for i in x or ()]) for x in arrow.col(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id"), pa.array(out, pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def codec_bytes(rank_file: str) -> dict[int, bytes]:
    return {rank: token for token, rank in segments.ranks(rank_file).items()}


def digests(docs: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, and the columns named in ``keep``.

    A null or empty text has no tokens. Null ids stay null, repeated rows each
    give a row, an empty table gives none. Nothing is shuffled; a worker's memo
    of segments is bounded.
    """
    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text", *(f"`{c}`" for c in keep if c not in ("doc_id", "text")))
    keep = tuple(c for c in keep if c not in ("doc_id", "text"))
    schema = arrow.struct(rows, ["doc_id", *keep], "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(rank_file, pattern)
        cut = [segments.segments(t) for t in arrow.texts(batch)]
        numbers = own.numbers([s for x in cut for s in x])
        counts = np.concatenate([[0], np.cumsum(own.lens[numbers])])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        order, of_ids, of_bytes = numbers.tolist(), [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            of_ids.append(hashlib.sha256(",".join([own.decimal[k] for k in order[a:b]]).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(b"".join([own.decoded[k] for k in order[a:b]])).hexdigest())
        return pa.RecordBatch.from_arrays(
            [arrow.col(batch, "doc_id"), *(arrow.col(batch, c) for c in keep), pa.array(np.diff(counts[bounds])), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            names=schema.fieldNames(),
        )

    return arrow.map_text(rows, of_slice, schema, limit=SLICE_BYTES)
