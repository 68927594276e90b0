"""Word spans that an earlier document has too.

A window is ``window`` consecutive words. Each window has an anchor, the least
hash of its short word n-grams, so equal windows have equal anchors and few
positions of a text are anchors. Documents that share no anchor share no window.
Of the others, the windows around each shared anchor are compared: first all at
once, by a digest of the run of windows that have the anchor, then, for the
first document of each run, one by one. Both are told apart by the anchor and a
digest, 128 bits together, where windows with one anchor have an n-gram in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import scratch
from linkloom.llm import arrow, runs, shingles

_NO_ID = -(1 << 63)
#: Words in the n-grams that anchors are taken from.
ANCHOR = 8


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, its anchor's hash and position; the leftmost of equal ones."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = shingles.windows(hashes, min(ANCHOR, window))
    width = window - min(ANCHOR, window) + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(hashes) - window + 1)
    return grams[at], at


def split(text: str) -> list[bytes]:
    """Words between white space, unchanged."""
    return text.encode().split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def _documents(rows: DataFrame, window: int) -> DataFrame:
    """Per row: how many words, a hash of them all, and its distinct anchors."""
    schema = arrow.struct(rows, ["doc_id", "doc", "version"], "n_words long, whole_sha256 string, anchors array<long>")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, found = [], [], []
        for text in arrow.texts(batch):
            words = split(text)
            counts.append(len(words))
            shas.append(_sha(words))
            found.append(np.unique(anchors(shingles.word_hashes(words), window)[0]).view(np.int64))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(arrow.col(batch, c) for c in ("doc_id", "doc", "version")), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=schema.fieldNames())

    return arrow.map_text(rows, of_slice, schema)


def _stretches(texts: DataFrame, window: int) -> DataFrame:
    """A row for each run of windows with one shared anchor: where it starts, and a hash of each window."""
    schema = arrow.struct(texts, ["doc", "version"], "anchor long, digest long, start int, hashes array<long>")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, anchor, digest, start, lens, hashes = [], [], [], [], [], []
        for i, (text, shared) in enumerate(zip(arrow.texts(batch), arrow.col(batch, "anchors"))):
            own = shingles.word_hashes(split(text))
            least, at = anchors(own, window)
            if not len(at):
                continue
            each = shingles.windows(own, window)
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            heads_on = heads[np.isin(least[heads], shared.values.to_numpy(zero_copy_only=False).view(np.uint64))]
            ends = np.concatenate([heads[1:], [len(at)]])[np.searchsorted(heads, heads_on)]
            for a, b in zip(heads_on.tolist(), ends.tolist()):
                rows.append(i)
                anchor.append(least[a])
                # the first and the last window's hashes and the offset fix all words of the run
                digest.append(shingles.mix(each[a : a + 1] * np.uint64(3) + shingles.mix(each[b - 1 : b] + np.uint64((int(at[a]) - a) << 32 | b - a)))[0])
                start.append(a)
                lens.append(b - a)
                hashes.append(each[a:b])
        pick = pa.array(rows, pa.int64())
        ends = np.cumsum([0, *lens]).astype(np.int32)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                arrow.col(batch, "doc").take(pick),
                arrow.col(batch, "version").take(pick),
                pa.array(np.array(anchor, np.uint64).view(np.int64)),
                pa.array(np.array(digest, np.uint64).view(np.int64)),
                pa.array(start, pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
            ],
            names=schema.fieldNames(),
        )

    return arrow.map_text(texts, of_slice, schema)


def _cut(words: list[bytes], starts: list[int], counts: list[int], window: int) -> np.ndarray:
    """Which words no removed window covers; window ``start + i`` for each ``i`` below its count is removed."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.array(starts) + np.array(counts) + window - 1, -1)
    return np.cumsum(edge[:-1]) == 0


def remove(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (null where nothing is removed).

    A word goes if a window that covers it also starts in a document with a
    smaller id; windows are judged on the input. The kept words are joined by
    one space. A null id counts as the least one; rows with one id are one
    document, none of them earlier than the other. Null and empty texts have no
    words. An empty table gives no rows; other columns are ignored.
    """
    rows = _plain(docs, id_col, text_col)
    whole = scratch.written(_documents(rows, window), "documents")
    places = whole.select("doc", "version", F.explode("anchors").alias("anchor")).distinct()
    shared = runs.scan(places, ["anchor"], "doc", at_least=2, name="anchors")
    wanted = shared.groupBy("doc", "version").agg(F.collect_set("anchor").alias("anchors"))
    texts = scratch.written(rows.drop("doc_id").join(wanted, ["doc", "version"]).dropDuplicates(["doc", "version"]), "texts")

    stretches = runs.scan(scratch.written(_stretches(texts, window), "stretches"), ["anchor", "digest"], "doc", flag=True, name="flagged")
    later = stretches.where("_later").select("doc", "version", "start", F.size("hashes").alias("n"))
    first = stretches.where("not _later").select("anchor", "doc", "version", F.posexplode("hashes").alias("i", "hash"), "start")
    single = runs.scan(first, ["anchor", "hash"], "doc", later=True, name="windows").select("doc", "version", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"))
    spans = later.unionByName(single).groupBy("doc", "version").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))

    joined = texts.drop("anchors").join(spans, ["doc", "version"])
    schema = arrow.struct(joined, ["doc", "version"], "n_removed long, kept_sha256 string, kept_text string")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, kept_texts = [], [], []
        for text, starts, lens in zip(arrow.texts(batch), arrow.col(batch, "starts").to_pylist(), arrow.col(batch, "counts").to_pylist()):
            words = split(text)
            kept = [w for w, k in zip(words, _cut(words, starts, lens, window).tolist()) if k]
            counts.append(len(words) - len(kept))
            shas.append(_sha(kept))
            kept_texts.append(b" ".join(kept).decode())
        return pa.RecordBatch.from_arrays([arrow.col(batch, "doc"), arrow.col(batch, "version"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())], names=schema.fieldNames())

    cut = arrow.map_text(joined, of_slice, schema)
    out = whole.drop("anchors").join(cut, ["doc", "version"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_text")
