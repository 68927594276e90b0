"""Ranked predictions and their slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The least probability, exclusive, and the rows of a report.
CUT, ROWS = 0.5, 100


def _top(found: DataFrame, rows: int) -> DataFrame:
    return found.orderBy(F.desc("link_probability"), "i", "j").limit(rows)


def predictions(scored: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows above the cut."""
    return scored.where(F.col("link_probability") > cut)


def overall(scored: DataFrame, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    return _top(predictions(scored, cut), rows)


def of_cluster(scored: DataFrame, cluster: int | None, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    """Pairs with an end in the cluster; none without a cluster, as when the start node was pruned."""
    return _top(predictions(scored, cut).where((F.col("cluster_node_1") == cluster) | (F.col("cluster_node_2") == cluster)), rows)


def of_node(scored: DataFrame, title: str, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    return _top(predictions(scored, cut).where((F.col("node_1") == title) | (F.col("node_2") == title)), rows)


def across_clusters(scored: DataFrame, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    """Pairs in different clusters; noise counts as one cluster."""
    return _top(predictions(scored, cut).where("cluster_node_1 <> cluster_node_2"), rows)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """``cluster, size`` of the clusters there are."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_members(clusters: DataFrame, node) -> DataFrame:
    """``node, cluster`` of all nodes in the node's cluster; none if the node isn't there."""
    own = clusters.where(F.col("node") == node).select("cluster").distinct()
    return clusters.join(own, "cluster", "left_semi").select("node", "cluster")
