"""Arrow batches cut to a bounded number of text bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A slice that is worked on at once holds at most this much text, or a single row.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096


_at_end: list[Callable[[], None]] = []


def at_task_end(forget: Callable[[], None]) -> None:
    """Has a Python worker forget something when its task ends; workers outlive tasks and share an executor's memory."""
    _at_end.append(forget)


def task_ends() -> None:
    """Gives back what this worker holds beyond its task."""
    for forget in _at_end:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only the id, the text and what is asked for: other columns, whatever their names, are pruned at the scan."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(k) for k, c in more.items()))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size, so that memory doesn't follow Spark's batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > limit or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def map_text(df: DataFrame, of_slice: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` by slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = part = None
        for part in slices(batches, column, limit):
            out = of_slice(part)
            if out is not None and out.num_rows:
                yield out
        del out, part
        task_ends()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def struct(df: DataFrame, keep: list[str], added: str) -> T.StructType:
    """Fields of ``df`` named in ``keep``, all nullable, and those of the DDL string ``added``."""
    return T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + list(T._parse_datatype_string(added).fields))
