"""Graphs and link lists from files and tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text

#: The destination of each anchor in a page.
HREF = r'href="([^"]*)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``title, pos, link``: the anchors of each page in page order; a page without any gives no row."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))
    return pages.select(F.col(id_col).alias("title"), F.posexplode(found).alias("pos", "link"))


def page_categories(pages: DataFrame, strict: bool = False) -> DataFrame:
    """``title, pos, category`` of pages with a list of raw ``categories``, the marker before each stripped as :func:`text.strip_category` does."""
    each = pages.select("title", F.posexplode("categories").alias("pos", "raw")).where("raw is not null")
    return each.select("title", "pos", text.strip_category(F.col("raw"), strict).alias("category"))


def link_lists(links: DataFrame) -> DataFrame:
    """``title, links``: the long form gathered to arrays, in order of ``pos``."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", "link")))
    return links.groupBy("title").agg(F.transform(pairs, lambda x: x["link"]).alias("links"))


def co_members(rows: DataFrame, group_col: str, member_col: str) -> DataFrame:
    """``src, dst`` with ``src < dst``: members that share a group, each pair once; nulls belong to no group."""
    own = rows.select(F.col(group_col).alias("g"), F.col(member_col).cast("long").alias("m")).where("g is not null and m is not null").distinct()
    a, b = own.withColumnRenamed("m", "src"), own.withColumnRenamed("m", "dst")
    return a.join(b, "g").where("src < dst").select("src", "dst").distinct()


def returned_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main graph over the test tables: parts linked when two returned items of them share an order."""
    return co_members(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_partkey")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, title, categories, cluster`` of each part; the cluster is a stand-in by size, -1 for noise."""
    name = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node"),
        F.col("p_name").alias("title"),
        F.concat(F.array("p_type", "p_brand"), name).alias("categories"),
        F.when(F.col("p_size") > 45, -1).otherwise(F.col("p_size") % 8).cast("int").alias("cluster"),
    )


def write_graph(edges: DataFrame, folder: str, start: str, depth: int, **tables: DataFrame) -> str:
    """Writes edges and other tables under a folder named by the query; returns the path."""
    path = graph_path(folder, start, depth)
    for name, df in {"edges": edges, **tables}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def graph_path(folder: str, start: str, depth: int) -> str:
    return f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9 ._-]', '_', start)}_(Depth: {depth})".replace(":", "=")


def cached_graph(spark: SparkSession, folder: str, start: str, depth: int, build) -> dict[str, DataFrame]:
    """The tables written for a query, built first if their path is missing; other failures are raised."""
    path = graph_path(folder, start, depth)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/edges/_SUCCESS")):
        tables = build()
        write_graph(tables.pop("edges"), folder, start, depth, **tables)
    return {f.getPath().getName(): spark.read.parquet(f.getPath().toString()) for f in fs.listStatus(target) if f.isDirectory()}


def read_gexf(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` labels of a GEXF file's edges, by the built-in XML source."""
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _label string").load(path)
    a = nodes.select(F.col("_id").alias("_source"), F.coalesce("_label", "_id").alias("src"))
    b = nodes.select(F.col("_id").alias("_target"), F.coalesce("_label", "_id").alias("dst"))
    return edges.join(a, "_source").join(b, "_target").select("src", "dst")


def write_gexf(edges: DataFrame, path: str) -> None:
    """A GEXF file of labelled edges, streamed to the driver a partition at a time."""
    from xml.sax.saxutils import quoteattr

    labels = edges.select(F.col("src").alias("x")).unionByName(edges.select(F.col("dst").alias("x"))).distinct()
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf version="1.2"><graph defaultedgetype="undirected">\n<nodes>\n')
        for r in labels.toLocalIterator():
            out.write(f"<node id={quoteattr(str(r.x))} label={quoteattr(str(r.x))}/>\n")
        out.write("</nodes>\n<edges>\n")
        for n, r in enumerate(edges.toLocalIterator()):
            out.write(f'<edge id="{n}" source={quoteattr(str(r.src))} target={quoteattr(str(r.dst))}/>\n')
        out.write("</edges>\n</graph></gexf>\n")
