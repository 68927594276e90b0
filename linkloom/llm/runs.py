"""Runs of equal keys over range partitions, however long a run is.

Rows are dealt by ranges of ``(key, item)`` and sorted, so a hot key fills
several partitions instead of one task. Each task streams its rows and holds
one batch. Only a partition's first and last run can go on in another partition;
of these the tasks leave a short summary, which settles them afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom import scratch

#: What a streamed row stands for.
_SURE, _PENDING, _SUMMARY, _FIRST = 0, 1, 2, 3


class _Streamer:
    """Streams sorted rows; ``keys`` and ``item`` are names of long columns without nulls."""

    def __init__(self, names: list[str], keys: list[str], item: str, at_least: int, later: bool, flag: bool) -> None:
        self.names, self.keys, self.item, self.n, self.later, self.flag = names, keys, item, at_least, later, flag
        self.held: list[pa.RecordBatch] = []  # rows of the open run, as long as they don't decide it
        self.key: tuple | None = None
        self.count, self.first, self.last, self.opening = 0, 0, 0, True

    def _out(self, batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        n = batch.num_rows
        zero = pa.array(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, kind, np.int32)), zero, zero], names=[*self.names, "_kind", "_count", "_least"])

    def _close(self, final: bool):
        """The end of the open run; it may go on elsewhere if it is the partition's first or last."""
        if self.key is None:
            return
        if self.opening or final:
            yield from (self._out(b, _PENDING) for b in self.held)
            values = dict(zip(self.keys, self.key)) | {self.item: self.first, "_kind": _SUMMARY, "_count": self.count, "_least": self.first}
            yield pa.RecordBatch.from_pylist([{c: values.get(c) for c in self.schema.names}], schema=self.schema)
        elif not self.later and self.count >= self.n:
            yield from (self._out(b, _SURE) for b in self.held)
        self.held, self.opening = [], False

    def run(self, batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            self.schema = pa.schema([*((f.name, f.type) for f in batch.schema), ("_kind", pa.int32()), ("_count", pa.int64()), ("_least", pa.int64())])
            keys = [batch.column(self.names.index(k)).to_numpy(zero_copy_only=False) for k in self.keys]
            items = batch.column(self.names.index(self.item)).to_numpy(zero_copy_only=False)
            change = np.zeros(len(items), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            change[0] = self.key is None or tuple(k[0].item() for k in keys) != self.key
            heads = np.flatnonzero(change)
            if not change[0]:
                stop = int(heads[0]) if len(heads) else len(items)
                yield from self._extend(batch, items, 0, stop)
            if not len(heads):
                continue
            # runs that begin and end inside this batch are settled at once
            yield from self._close(False)
            self.key = None
            stops = np.concatenate([heads[1:], [len(items)]])
            whole = len(heads) - 1
            if self.opening and whole:
                self._begin(keys, items, heads[0])
                yield from self._extend(batch, items, int(heads[0]), int(stops[0]))
                yield from self._close(False)
                heads, stops, whole = heads[1:], stops[1:], whole - 1
            if whole:
                a, b = int(heads[0]), int(stops[whole - 1])
                new = np.ones(b - a, bool)
                new[1:] = change[a + 1 : b] | (items[a + 1 : b] != items[a : b - 1])
                lens = stops[:whole] - heads[:whole]
                if self.later:
                    take = items[a:b] != np.repeat(items[heads[:whole]], lens)
                else:
                    take = np.repeat(np.add.reduceat(new.astype(np.int64), heads[:whole] - a) >= self.n, lens)
                yield from self._told(batch.slice(a, b - a), take)
            self._begin(keys, items, heads[-1])
            yield from self._extend(batch, items, int(heads[-1]), int(stops[-1]))
        yield from self._close(True)

    def _told(self, part: pa.RecordBatch, take: np.ndarray):
        if take.any():
            yield self._out(part.filter(pa.array(take)), _SURE)
        if self.flag and not take.all():
            yield self._out(part.filter(pa.array(~take)), _FIRST)

    def _begin(self, keys, items, at) -> None:
        self.key = tuple(k[at].item() for k in keys)
        self.count, self.first, self.last = 0, items[at].item(), None

    def _extend(self, batch: pa.RecordBatch, items: np.ndarray, a: int, b: int):
        own = items[a:b]
        self.count += int((own[1:] != own[:-1]).sum()) + (self.last is None or own[0].item() != self.last)
        self.last = own[-1].item()
        part = batch.slice(a, b - a)
        if self.opening:  # another partition may hold the run's first rows
            yield self._out(part, _PENDING)
        elif self.later:
            yield from self._told(part, own != self.first)
        elif self.count >= self.n:
            yield from (self._out(x, _SURE) for x in self.held)
            self.held = []
            yield self._out(part, _SURE)
        else:
            self.held.append(part)


def scan(rows: DataFrame, keys: list[str], item: str, at_least: int = 2, later: bool = False, flag: bool = False, name: str = "runs") -> DataFrame:
    """The rows whose key has at least ``at_least`` distinct items; with ``later``, those whose item isn't their key's least.

    With ``flag``, all rows, and in ``_later`` whether ``later`` would have them.
    ``keys`` and ``item`` are long columns without nulls. Rows with the same key
    and item stay together. The result is a written table; an empty input gives
    an empty one.
    """
    names = rows.columns
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema] + list(T._parse_datatype_string("_kind int, _count long, _least long").fields))
    sort = [*keys, item]
    later = later or flag

    def run(batches):
        yield from _Streamer(names, keys, item, at_least, later, flag).run(batches)

    streamed = scratch.written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(run, schema), name)
    # at most two rows a partition; every row passes it, so that a hot key's rows take no way of their own
    open_runs = streamed.where(F.col("_kind") == _SUMMARY).groupBy(*keys).agg(F.sum("_count").alias("_n"), F.min("_least").alias("_low"))
    told = streamed.where(F.col("_kind") != _SUMMARY).drop("_count", "_least").join(F.broadcast(open_runs), keys, "left")
    settled = F.col(item) != F.col("_low") if later else F.col("_n") >= at_least
    wanted = F.when(F.col("_kind") == _PENDING, settled).otherwise(F.col("_kind") == _SURE)
    return told.select(*names, wanted.alias("_later")) if flag else told.where(wanted).select(*names)
