"""Lines that many documents share, as compressed keep bitmaps.

Each document gives its distinct line keys with their positions. The keys'
hashes are dealt by ranges with a secondary sort by document; the streamed runs
tell how many documents a key is in, or which document has it first. What comes
back to a document is a bitmap of the lines it keeps, not text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import arrow, runs

_NO_ID = -(1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With ``doc`` (the id, null as the least long) and ``version`` (tells texts of one id apart)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case; bytes methods touch nothing but ASCII."""
    return line.strip().lower()


def line_keys(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``h1, h2, doc, version, n_lines, positions``: a row for each document's distinct key of ``min_chars`` code points or more."""
    rows = _rows(docs, id_col, text_col)
    schema = arrow.struct(rows, ["doc", "version"], "h1 long, h2 long, n_lines int, positions array<int>")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, low, high, totals, positions = [], [], [], [], []
        for i, text in enumerate(arrow.texts(batch)):
            own: dict[bytes, list[int]] = {}
            lines = text.encode().split(b"\n")
            for n, line in enumerate(lines):
                own.setdefault(line_key(line), []).append(n)
            for key, where in own.items():
                if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                    digest = xxhash.xxh3_128_digest(key)
                    at.append(i)
                    low.append(digest[:8])
                    high.append(digest[8:])
                    totals.append(len(lines))
                    positions.append(where)
        pick = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                arrow.col(batch, "doc").take(pick),
                arrow.col(batch, "version").take(pick),
                pa.array(np.frombuffer(b"".join(low), np.int64)),
                pa.array(np.frombuffer(b"".join(high), np.int64)),
                pa.array(totals, pa.int32()),
                pa.array(positions, pa.list_(pa.int32())),
            ],
            names=schema.fieldNames(),
        )

    return arrow.map_text(rows, of_slice, schema)


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """Dropped positions by document, as a compressed bitmap of what is kept."""
    grouped = dropped.groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("positions")).alias("positions"))
    schema = arrow.struct(grouped, ["doc", "version"], "n_dropped long, keep binary")

    def run(batches):
        for batch in batches:
            counts, keeps = [], []
            for n, where in zip(arrow.col(batch, "n_lines").to_pylist(), arrow.col(batch, "positions").to_pylist()):
                kept = np.ones(n, bool)
                kept[where] = False
                counts.append(n - int(kept.sum()))
                keeps.append(zlib.compress(np.packbits(kept).tobytes()))
            yield pa.RecordBatch.from_arrays([arrow.col(batch, "doc"), arrow.col(batch, "version"), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], names=schema.fieldNames())

    return grouped.mapInArrow(run, schema)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, version, n_dropped, keep`` of each document that loses lines.

    ``keep="none"`` drops every line whose key at least ``min_docs`` documents
    have; ``keep="first"`` drops every line whose key an earlier document, or an
    earlier line of the same one, has. Rows with a null id count as one document,
    the least; so do several rows with one id, of which each text has its own
    ``version`` and bitmap. Null and empty texts are one empty line, whose key is
    too short to count. Empty tables and other columns are harmless.
    """
    keys = line_keys(docs, min_chars, id_col, text_col)
    if keep == "none":
        dropped = runs.scan(keys, ["h1", "h2"], "doc", at_least=min_docs, name="lines")
    elif keep == "first":
        later = runs.scan(keys, ["h1", "h2"], "doc", later=True, name="lines")
        again = keys.where(F.size("positions") > 1).withColumn("positions", F.expr("slice(positions, 2, size(positions) - 1)"))
        dropped = later.unionByName(again)
    else:
        raise ValueError(f"no such rule: {keep}")
    return _bitmaps(dropped.dropDuplicates(["doc", "version", "h1", "h2", "positions"]))


def _kept(text: str, keep: bytes | None) -> tuple[str, int]:
    """The kept lines, and how many lines there were."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([x for x, b in zip(lines, bits.tolist()) if b]), len(lines)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` as ``_row``, with their text and bitmap; a sort-merge join that can split a hot range."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("version"),
    )
    return rows.join(bitmaps, ["doc", "version"], "left")


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` without the lines their bitmaps drop; a null text stays null.

    ``chars_col`` names a column of text lengths in code points to be kept true.
    """
    joined = _with_bitmaps(docs, bitmaps, id_col, text_col).select("_row.*", F.col("keep").alias("_keep"))
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in arrow.slices(batches, text_col):
            columns = batch.columns[:-1]
            new = [None if t is None else _kept(t, k)[0] for t, k in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
        arrow.task_ends()

    out = joined.mapInArrow(run, schema)
    return out if chars_col is None else out.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType))


def digest(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, kept_sha256, keep`` (null where nothing is dropped)."""
    joined = _with_bitmaps(docs.select(id_col, text_col), bitmaps, id_col, text_col).select(F.col(f"_row.{id_col}").alias("doc_id"), F.col(f"_row.{text_col}").cast("string").alias("text"), "n_dropped", "keep")
    schema = arrow.struct(joined, ["doc_id"], "n_lines long, n_dropped long, kept_sha256 string, keep binary")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas = [], []
        for text, keep in zip(arrow.texts(batch), arrow.col(batch, "keep").to_pylist()):
            kept, n = _kept(text, keep)
            counts.append(n)
            shas.append(hashlib.sha256(kept.encode()).hexdigest())
        dropped = arrow.col(batch, "n_dropped").fill_null(0)
        return pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id"), pa.array(counts, pa.int64()), dropped, pa.array(shas, pa.string()), arrow.col(batch, "keep")], names=schema.fieldNames())

    return arrow.map_text(joined, of_slice, schema)
