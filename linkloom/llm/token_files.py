"""Token ids as Parquet list columns that can be read selectively.

Ids are dictionary-encoded (the vocabulary bounds the dictionary), document ids
and counts are delta-encoded, row groups and pages have set sizes, and column
indexes let a reader skip pages by document id and leave the ids unread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom import scratch
from linkloom.llm import arrow, segments

#: Fixed by the contract: the id that ends each document.
END_ID = 2
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes ``part, row, doc_id, n_tokens, ids`` in ascending ``doc_id`` order.

    Files follow the order of ``part``, rows in a file that of ``row``. A null
    text is empty (its ids are the end id alone); null ids come first; equal ids
    are ordered by a hash of the text, equal rows are each written. An empty
    table gives a table without rows. Other columns are ignored. One range
    exchange moves the texts; no task holds more than its range.
    """
    rows = arrow.base(docs, id_col, text_col, tie=F.xxhash64(F.col(text_col)))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))
    schema = arrow.struct(rows, ["doc_id"], "part int, row long, n_tokens long, ids array<int>")

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        encoder = segments.library_encoder(vocabulary)
        for batch in arrow.slices(batches, "text"):
            ids, bounds = encoder.encode(arrow.texts(batch))
            n = batch.num_rows
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [arrow.col(batch, "doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(np.diff(bounds)), segments.ids_column(ids, bounds)],
                names=schema.fieldNames(),
            )
            row += n
        arrow.task_ends()

    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#row": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    ranged.mapInArrow(run, schema).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """The table of :func:`write`; ``first`` and ``last`` (inclusive) skip pages, ``ids=False`` leaves the tokens unread."""
    found = spark.read.parquet(path)
    if first is not None:
        found = found.where(F.col("doc_id") >= first)
    if last is not None:
        found = found.where(F.col("doc_id") <= last)
    return found if ids else found.drop("ids")


def starts(files: DataFrame) -> DataFrame:
    """``part, row, start``: the ids of all documents before each one.

    Totals by file are as many rows as files; the running sum inside a file is
    bounded by the range that one task wrote. The ids themselves aren't read.
    """
    files = files.select("part", "row", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), "part").select("part", "row", (F.col("offset") + F.col("inside")).alias("start"))


def checksums(files: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in files.columns if c != "ids"]
    schema = arrow.struct(files, keep, "ids_crc32 long")

    def run(batches):
        for batch in batches:
            column = arrow.col(batch, "ids")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
            ends = ends - ends[0]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(arrow.col(batch, c) for c in keep), pa.array(crc, pa.int64())], names=schema.fieldNames())

    return files.mapInArrow(run, schema)


def digest(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and returns what is read back from them."""
    path = scratch.new_path(spark, "tokens")
    write(docs, path, vocabulary)
    return checksums(read(spark, path)).join(starts(read(spark, path, ids=False)), ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")
