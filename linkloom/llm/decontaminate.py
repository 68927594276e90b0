"""Training passages that come from test items, found by rare seeds and scored by alignment.

Each item's rarer word n-grams, by how often chance would give them in the
corpus, are seeds; an item of fewer words is its own. Where a document has a
seed, the passage around it is aligned with the item by Smith-Waterman, so
edited and shortened copies score too.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import arrow

#: Words in a seed.
SEED = 3
#: The share of an item's n-grams, the rarest first, that are seeds; of a short item so many at least.
SEED_SHARE, LEAST_SEEDS = 0.6, 24
#: The least alignment score, as a share of the item aligned with itself.
MIN_SCORE = 0.5
#: A passage that scores as so many words in a row is reported however long the item is.
RUN_WORDS = 25
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that are broadcast at once; more items are dealt into passes of that size.
PASS_WORDS = 1_000_000

_PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation is white space, so edits of it don't count."""
    return text.lower().encode().translate(_PUNCTUATION).split()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score, and where it ends in ``a`` and ``b`` (exclusive).

    A row at a time: the gaps along a row are a running maximum.
    """
    steps = -GAP * np.arange(1, len(b) + 1)
    above = np.zeros(len(b) + 1, np.int64)
    best, at = 0, (0, 0)
    for i in range(len(a)):
        here = np.maximum(above[:-1] + np.where(b == a[i], MATCH, MISMATCH), above[1:] + GAP)
        here = np.maximum.accumulate(np.maximum(here, 0) + steps) - steps
        top = int(here.argmax())
        if here[top] > best:
            best, at = int(here[top]), (i + 1, top + 1)
        above[1:] = here
    return best, *at


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best score of an item and a passage, and the span of the passage that has it."""
    score, of_item, end = align(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = align(item[:of_item][::-1], passage[:end][::-1])
    return score, end - back, end


class _Seeds:
    """The items of one pass, their vocabulary, and the seeds in sorted order."""

    def __init__(self, items: list[tuple[int, list[bytes]]]) -> None:
        self.number: dict[bytes, int] = {}
        self.items = [(k, np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64)) for k, ws in items]
        self.base = len(self.number) + 1

    def keys(self, ids: np.ndarray, n: int = SEED) -> np.ndarray:
        """A number of each ``n`` words in a row. Beyond two million words some share one: that costs alignments alone."""
        out = ids[: max(0, len(ids) - n + 1)].copy()
        for i in range(1, n):
            out = out * self.base + ids[i : len(ids) - n + 1 + i]
        return out

    def choose(self, counts: np.ndarray, total: int) -> None:
        """Keeps the rarer seeds of each item, by the logarithm of the count that chance would give."""
        logs = np.log(np.maximum(counts, 1) / max(1, total))
        found: dict[int, list[tuple[int, int, int]]] = {n: [] for n in range(1, SEED + 1)}
        for k, (_, ids) in enumerate(self.items):
            n = min(SEED, len(ids))
            if n:
                expected = sum(logs[ids[i : len(ids) - n + 1 + i]] for i in range(n))
                for q in np.argsort(expected, kind="stable")[: max(LEAST_SEEDS, round(SEED_SHARE * len(expected)))].tolist():
                    found[n].append((int(self.keys(ids, n)[q]), k, q))
        #: By the words in a seed: sorted keys, and the item and the place in it of each.
        self.seeds = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(x))) for n, x in found.items() if x}

    def ids(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, ws, repeat(0)), np.int64, len(ws))


def _passages(seeds: _Seeds, ids: np.ndarray):
    """``(item number, first word, end)`` of every stretch around the seeds of one item that lie within its reach."""
    hits: dict[int, list[tuple[int, int]]] = {}
    for n, (sorted_keys, of_item, offset) in seeds.seeds.items():
        if len(ids) < n:
            continue
        run = ids[: len(ids) - n + 1] > 0
        for i in range(1, n):
            run &= ids[i : len(ids) - n + 1 + i] > 0
        at = np.flatnonzero(run)
        if not len(at):
            continue
        keys = seeds.keys(ids, n)[at]
        lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
        for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for s in range(a, b):
                hits.setdefault(int(of_item[s]), []).append((p, int(offset[s])))
    for n, where in hits.items():
        size = len(seeds.items[n][1])
        slack = size + SEED  # an alignment that scores has fewer gaps than the item has words
        spans = sorted((p - q - slack, p - q + size + slack) for p, q in where)
        first, end = spans[0]
        for a, b in spans[1:]:
            if a > end:
                yield n, max(0, first), min(len(ids), end)
                first, end = a, b
            end = max(end, b)
        yield n, max(0, first), min(len(ids), end)


def _chosen(rows: DataFrame, items: list[tuple[int | None, list[bytes]]]) -> _Seeds:
    """The items' seeds, by how often each of their words stands in all texts of ``rows``."""
    seeds = _Seeds(items)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, total = np.zeros(seeds.base, np.int64), 0
        for text in arrow.texts(batch):
            ids = seeds.ids(words(text))
            total += len(ids)
            sums += np.bincount(ids, minlength=seeds.base)
        sums[0] = total
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["word", "n"])

    counts = np.zeros(seeds.base, np.int64)
    for r in arrow.map_text(rows.select("text"), count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # the items' vocabulary at most
        counts[r.word] = r.n
    seeds.choose(counts, int(counts[0]))
    return seeds


def _passes(rows: DataFrame, benchmark: DataFrame, pass_words: int):
    """The seeds of at most ``pass_words`` words of items at a time, or of a single longer item."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    held, size = [], 0
    for item in tests.orderBy("item_id", "text").toLocalIterator():
        own = words(item.text)
        if held and size + len(own) > pass_words:
            yield _chosen(rows, held)
            held, size = [], 0
        if own:
            held.append((item.item_id, own))
            size += len(own)
    if held:
        yield _chosen(rows, held)


def _found(seeds: _Seeds, ws: list[bytes], min_score: float, least_words: int = 1) -> list[tuple[int, float, int, int]]:
    """``(item number, score, first word, end)`` of the best passage of each item that has one."""
    ids, best = seeds.ids(ws), {}
    for n, first, end in _passages(seeds, ids):
        item = seeds.items[n][1]
        if len(item) < least_words:
            continue
        got, a, b = aligned(item, ids[first:end])
        value = got / (MATCH * len(item))
        if (value >= min_score or got >= MATCH * RUN_WORDS) and value > best.get(n, (0.0,))[0]:
            best[n] = value, first + a, first + b
    return [(n, *x) for n, x in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word, passage`` of each document and test item that align well.

    ``score`` is the best local alignment as a share of the item aligned with
    itself; the span is in words of the document. A passage counts that has
    ``min_score``, or scores as ``RUN_WORDS`` words in a row. An item of fewer
    words than a seed has is found where all of it stands. Null and empty texts
    and items have no words and no leaks; a null ``item_id`` or ``doc_id`` stays
    null; of equal items one counts, and items that share an id are found each by
    itself; repeated rows each give their rows; empty tables give none.
    Documents are never shuffled: items are broadcast, at most ``pass_words``
    words at once, and more of them take more passes.
    """
    rows = arrow.base(docs, id_col, text_col)
    schema = arrow.struct(rows, ["doc_id"], "item_id long, score double, first_word long, end_word long, passage string")
    out = None
    for seeds in _passes(rows, benchmark, pass_words):
        shared = rows.sparkSession.sparkContext.broadcast(seeds)

        def score(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            own, at, found = shared.value, [], [[] for _ in range(5)]
            for i, text in enumerate(arrow.texts(batch)):
                ws = words(text)
                for n, value, a, b in _found(own, ws, min_score):
                    at.append(i)
                    for column, x in zip(found, (own.items[n][0], value, a, b, b" ".join(ws[a:b]).decode())):
                        column.append(x)
            ids = arrow.col(batch, "doc_id").take(pa.array(at, pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(found, kinds))], names=schema.fieldNames())

        found = arrow.map_text(rows, score, schema)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text", pass_words: int = PASS_WORDS, least_words: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no leak.

    Every row is judged by its own text, whatever its id. Items of fewer than
    ``least_words`` words, which any clean text may have, drop nothing. Edge
    cases are those of :func:`leaks`; nothing is shuffled or joined.
    """
    at, out = docs.columns.index(text_col), docs
    for seeds in _passes(docs.select(F.col(text_col).cast("string").alias("text")), benchmark, pass_words):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            for batch in arrow.slices(batches, text_col):
                kept = [not _found(shared.value, words(t.as_py() or ""), min_score, least_words) for t in batch.column(at)]
                if any(kept):
                    yield batch.filter(pa.array(kept, pa.bool_()))
            arrow.task_ends()

        out = out.mapInArrow(run, docs.schema)
    return out
