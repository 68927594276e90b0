"""Spans of a given reference, by suffix automata of its shards.

Each shard's automaton is broadcast; documents are streamed through it for
matching statistics, the length of the longest reference string that ends at
each word. Where that reaches the threshold, the span goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import arrow

#: Words of reference in one automaton, and automata that are broadcast for one pass over the documents.
SHARD_WORDS, PASS_SHARDS = 100_000, 8


class SuffixAutomaton:
    """The smallest automaton of all substrings of the passages added to it."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of ``q`` for the strings that ``p`` and shorter ones reach by ``word``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, passage: list[bytes]) -> None:
        last = 0
        for word in passage:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, words: list[bytes]) -> np.ndarray:
        """For each word, how many words up to it are a substring of a passage."""
        out, state, length = np.zeros(len(words), np.int64), 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            found = self.next[state].get(word)
            if found is None:
                length = 0
            else:
                state, length = found, length + 1
            out[i] = length
        return out


def covered(lengths: np.ndarray, window: int) -> np.ndarray:
    """The words of all spans of at least ``window`` words that the matching statistics show."""
    edge = np.zeros(len(lengths) + 1, np.int64)
    ends = np.flatnonzero(lengths >= window)
    np.add.at(edge, ends + 1 - lengths[ends], 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_text``, without the words of spans that a reference text has.

    A span is ``window`` words or more. Reference texts (column ``text``) are
    read to the driver a shard at a time; a pass takes at most ``PASS_SHARDS``
    shards and documents go through as many passes as that needs. Null and empty
    texts have no words; empty tables and other columns are harmless.
    """
    spark = docs.sparkSession
    marked = arrow.base(docs, id_col, text_col).withColumn("gone", F.lit(None).cast("binary"))
    schema = marked.schema

    def one_pass(df: DataFrame, shards: list) -> DataFrame:
        def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, gone in zip(arrow.texts(batch), arrow.col(batch, "gone").to_pylist()):
                words = text.encode().split()
                mask = np.zeros(len(words), bool) if gone is None else np.unpackbits(np.frombuffer(gone, np.uint8), count=len(words)).astype(bool)
                for shard in shards:
                    mask |= covered(shard.value.matches(words), window)
                out.append(np.packbits(mask).tobytes())
            return pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id"), arrow.col(batch, "text"), pa.array(out, pa.binary())], names=schema.fieldNames())

        return arrow.map_text(df, of_slice, schema)

    shards, held, size = [], SuffixAutomaton(), 0
    for r in reference.select(F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        words = r.text.encode().split()
        if size and size + len(words) > shard_words:
            shards.append(spark.sparkContext.broadcast(held))
            held, size = SuffixAutomaton(), 0
            if len(shards) == PASS_SHARDS:
                marked, shards = one_pass(marked, shards), []
        held.add(words)
        size += len(words)
    marked = one_pass(marked, [*shards, spark.sparkContext.broadcast(held)])
    result = arrow.struct(marked, ["doc_id"], "n_words long, n_removed long, kept_text string")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, lost, kept = [], [], []
        for text, gone in zip(arrow.texts(batch), arrow.col(batch, "gone").to_pylist()):
            words = text.encode().split()
            mask = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(words)).tolist()
            counts.append(len(words))
            lost.append(sum(mask))
            kept.append(b" ".join([w for w, m in zip(words, mask) if not m]).decode())
        return pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=result.fieldNames())

    return arrow.map_text(marked, cut, result)
