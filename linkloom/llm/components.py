"""Connected components of links, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import scratch


def _checked(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    kept = scratch.written(edges, name)
    mark = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return kept, (mark.n, mark.h)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node reachable, for each node that ``links`` (two columns of ids) has.

    Every round sends each node's neighbours to the least one it knows, first
    among the larger neighbours, then among the smaller. A hub's rows are summed
    before they are shuffled and its join can be split, so none is gathered in a
    task; each round's edges are a written table.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges, mark = _checked(links.select(u, v).where("u <> v").distinct(), "edges")
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.written(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new, seen = _checked(small, "edges")
        scratch.release(large)
        scratch.release(edges)
        edges = new
        if seen == mark:
            break
        mark = seen
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
