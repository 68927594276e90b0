"""Undirected graphs as canonical edges (``src < dst``): adjacency, degrees, balls, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.scratch import written

#: The most neighbours that pruning may ask of a node, and the quantile it asks of the graph.
MIN_LINKS, PRUNE_QUANTILE = 15, 0.33


def canonical(links: DataFrame, src: str = "src", dst: str = "dst", keep_loops: bool = False) -> DataFrame:
    """Each undirected edge once; loops go unless kept; edges with a null end go."""
    edges = links.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), (F.col(src).isNotNull() & F.col(dst).isNotNull()).alias("whole"))
    return edges.where("whole" if keep_loops else "whole and src <> dst").select("src", "dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a loop once."""
    return edges.select("src", "dst").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree`` as the adjacency matrix counts it: a loop is one."""
    return adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def incident_degrees(edges: DataFrame) -> DataFrame:
    """``node, degree`` as a graph counts it: a loop is two."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def quantile(values: DataFrame, column: str, q: float, frequency: int = 1) -> DataFrame:
    """One row, one column ``quantile``: linear interpolation, to 12 places so that engines agree."""
    return values.agg(F.round(F.expr(f"percentile(`{column}`, {q}D, {frequency})"), 12).alias("quantile"))


def degree_threshold(edges: DataFrame, min_links: int = MIN_LINKS, q: float = PRUNE_QUANTILE) -> DataFrame:
    """One row: the degrees' quantile, and the least degree that pruning asks for."""
    return quantile(incident_degrees(edges), "degree", q).withColumn("threshold", F.least(F.lit(float(min_links)), "quantile").cast("int"))


def prune(edges: DataFrame, min_links: int = MIN_LINKS, q: float = PRUNE_QUANTILE) -> DataFrame:
    """Edges between nodes whose degree reaches the threshold; one pass, so that survivors may end below it."""
    least = degree_threshold(edges, min_links, q).select("threshold").scalar()
    kept = incident_degrees(edges).where(F.col("degree") >= least).select("node")
    return _both_ends(edges, kept)


def _both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.withColumnRenamed("node", "src"), nodes.withColumnRenamed("node", "dst")
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The canonical edges of directed links with both ends among the nodes."""
    return canonical(_both_ends(links, nodes.select("node").distinct()))


def ball(links: DataFrame, start, depth: int) -> DataFrame:
    """``node, bfs_depth, parent``: what directed links reach from ``start`` in at most ``depth`` steps.

    ``parent`` is the least node of the level before that links to the node,
    null for the start. Each level is a written table.
    """
    kind = links.schema["src"].dataType
    seen = links.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("bfs_depth"), F.lit(None).cast(kind).alias("parent"))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(links.select("src", "dst"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("bfs_depth"), "parent")
        frontier = written(new, "frontier")
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return seen


def unfetched(nodes: DataFrame, fetched: DataFrame) -> DataFrame:
    """Nodes without a link list."""
    return nodes.join(fetched.select("node").distinct(), "node", "left_anti")


def complete(nodes: DataFrame, links: DataFrame, filtered: DataFrame) -> DataFrame:
    """The subgraph induced on a ball: inner nodes by their filtered links, nodes on the rim by all their links."""
    rim = nodes.agg(F.max("bfs_depth")).scalar()
    inner = nodes.where(F.col("bfs_depth") < rim).select(F.col("node").alias("src"))
    outer = nodes.where(F.col("bfs_depth") == rim).select(F.col("node").alias("src"))
    used = filtered.join(inner, "src", "left_semi").select("src", "dst").unionByName(links.join(outer, "src", "left_semi").select("src", "dst"))
    return induced(used, nodes)


def with_index(df: DataFrame, by: str, name: str = "index") -> DataFrame:
    """Numbers rows from 0 in order of a unique column, with a sum over partitions instead of one global window."""
    ranged = written(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.withColumn("_row", inside).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_row") - 1 + F.col("_offset")).cast("long")).drop("_part", "_row", "_offset")


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes and edges."""
    return incident_degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.expr("cast(sum(degree) div 2 as bigint)").alias("n_edges"))
