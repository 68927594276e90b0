"""Pairs that aren't linked but look as if they should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_clusters(pair_table: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds ``ci`` and ``cj``."""
    a = clusters.select(F.col("node").alias("i"), F.col("cluster").alias("ci"))
    b = clusters.select(F.col("node").alias("j"), F.col("cluster").alias("cj"))
    return pair_table.join(a, "i").join(b, "j")


def _weak(weak: Column) -> Column:
    return (F.col("ci") == F.col("cj")) & (F.col("ci") >= 0) & (F.round("similarity", 12) >= weak)


def _strong(strong: Column) -> Column:
    return F.round("similarity", 12) > strong


def candidates(
    pair_table: DataFrame,
    clusters: DataFrame,
    weak: Column | float,
    strong: Column | float,
    rule: str = "both",
    specific_cluster: int | None = None,
    specific_node: int | None = None,
) -> DataFrame:
    """``i, j, similarity``: stored pairs without an edge that pass the weak rule, the strong rule, or either.

    Weak: one cluster, not noise, similarity at least ``weak``; limited to a
    cluster or to pairs with a node if asked. Strong: similarity above
    ``strong``, in any clusters. One filter over one scan, so no pair twice.
    Pairs that aren't stored have similarity 0 and are left out, also where
    ``weak`` is 0.
    """
    weak, strong = (x if isinstance(x, Column) else F.lit(float(x)) for x in (weak, strong))
    first, second = _weak(weak), _strong(strong)
    if specific_cluster is not None:
        first &= F.col("ci") == specific_cluster
    if specific_node is not None:
        first &= (F.col("i") == specific_node) | (F.col("j") == specific_node)
    wanted = {"weak": first, "strong": second, "both": first | second}[rule]
    return with_clusters(pair_table.where("adj = 0"), clusters).where(wanted).select("i", "j", "similarity")


def top(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar, ties by ids."""
    return found.orderBy(F.desc("similarity"), "i", "j").limit(n)
