"""Neighbour similarity of stored pairs: those with a common neighbour or an edge; all others are zero."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import adjacency, degrees
from linkloom.scratch import written

#: Quantiles of the similarity over edges, for pairs in one cluster and for any pair.
WEAK_QUANTILE, STRONG_QUANTILE = 0.75, 0.95


def common_neighbors(edges: DataFrame) -> DataFrame:
    """``i, j, common`` with ``i < j`` and ``common > 0``: a self-join on the middle node, summed before the shuffle."""
    adj = adjacency(edges)
    x, y = adj.select(F.col("src").alias("i"), F.col("dst").alias("m")), adj.select(F.col("src").alias("m"), F.col("dst").alias("j"))
    return x.join(y, "m").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("common"))


def pairs(edges: DataFrame) -> DataFrame:
    """``i, j, common, adj, total, similarity`` of every stored pair, ``i < j``.

    ``total`` is both degrees less ``common`` and twice ``adj``; ``similarity``
    is ``common / total``, 0 where ``total`` is 0. The edges are counted in with
    the common neighbours, so one aggregation gives both.
    """
    wedges = common_neighbors(edges).withColumn("adj", F.lit(0))
    linked = edges.where("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(0).cast("long").alias("common"), F.lit(1).alias("adj"))
    stored = wedges.unionByName(linked).groupBy("i", "j").agg(F.sum("common").alias("common"), F.max("adj").alias("adj"))
    d = degrees(edges)
    di, dj = d.select(F.col("node").alias("i"), F.col("degree").alias("di")), d.select(F.col("node").alias("j"), F.col("degree").alias("dj"))
    total = F.col("di") + F.col("dj") - F.col("common") - 2 * F.col("adj")
    out = stored.join(di, "i").join(dj, "j").withColumn("total", total)
    return out.select("i", "j", "common", "adj", "total", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("common") / F.col("total")).alias("similarity"))


def total_neighbors(edges: DataFrame) -> DataFrame:
    return pairs(edges).select("i", "j", "total")


def jaccard(edges: DataFrame) -> DataFrame:
    return pairs(edges).select("i", "j", "similarity")


def affinity(pair_table: DataFrame) -> DataFrame:
    """``i, j, w``: similarity plus 1 for an edge."""
    return pair_table.select("i", "j", (F.col("similarity") + F.col("adj")).alias("w"))


class Affinity:
    """The affinities of a graph's pairs with the edges that tell them; pairs are stored once the table is asked for."""

    def __init__(self, edges: DataFrame, pair_table: DataFrame | None = None) -> None:
        self.edges, self._pairs = edges, pair_table

    @cached_property
    def table(self) -> DataFrame:
        return affinity(written(pairs(self.edges), "pairs") if self._pairs is None else self._pairs)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.table, name)


def distance(aff: DataFrame) -> DataFrame:
    """``i, j, d``: 1 less the affinity's share of the greatest; pairs that aren't listed are at 1."""
    top = aff.agg(F.max("w")).scalar()
    return aff.select("i", "j", F.when(top == 0, F.lit(1.0)).otherwise(1 - F.col("w") / top).alias("d"))


def thresholds(pair_table: DataFrame, weak: float = WEAK_QUANTILE, strong: float = STRONG_QUANTILE) -> DataFrame:
    """One row, ``weak, strong``: quantiles over the edges, each in both directions, to 12 places."""
    linked = pair_table.where("adj = 1")
    return linked.agg(*(F.round(F.expr(f"percentile(similarity, {q}D, 2)"), 12).alias(n) for n, q in (("weak", weak), ("strong", strong))))
