"""The whole analysis: graph, similarity, clusters, candidates, features, model, ranked pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import candidates, features, graph, model, report, similarity
from linkloom.operators.cluster import density, sweep
from linkloom.scratch import written

FEATURES = [c for c in features.COLUMNS if c not in ("node_1", "node_2", "link")]


@dataclass
class Settings:
    """Every parameter of the analysis."""

    depth: int = 2
    min_links: int = graph.MIN_LINKS
    prune_quantile: float = graph.PRUNE_QUANTILE
    weak: float = similarity.WEAK_QUANTILE
    strong: float = similarity.STRONG_QUANTILE
    link_blacklist: list[str] = field(default_factory=lambda: list(text.LINK_BLACKLIST))
    category_blacklist: list[str] = field(default_factory=lambda: list(text.CATEGORY_BLACKLIST))
    train_pairs: int | None = None
    space: dict[str, list] = field(default_factory=lambda: dict(model.GRID))
    n_splits: int = 2
    n_repeats: int = 1
    leaky: bool = False
    cut: float = report.CUT
    rows: int = report.ROWS


@dataclass
class Result:
    edges: DataFrame
    pairs: DataFrame
    clusters: DataFrame
    candidates: DataFrame
    scored: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    params: dict
    reports: dict[str, DataFrame]


def build_graph(links: DataFrame, start: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the pruned ball around ``start``; ``links`` is ``title, pos, link`` in the long form.

    Nodes are numbered by level, parent and title. Titles are filtered on the way out, the start never.
    """
    raw = links.select(F.col("title").alias("src"), F.col("link").alias("dst")).where("src is not null and dst is not null").distinct()
    filtered = text.without_substrings(raw, "dst", settings.link_blacklist)
    ball = written(graph.ball(filtered, start, settings.depth), "ball")
    named = ball.withColumn("key", F.struct("bfs_depth", F.coalesce("parent", F.lit("")).alias("parent"), F.col("node").alias("title")))
    numbered = graph.with_index(named, "key", "id").select("id", F.col("node").alias("title"), "bfs_depth")
    whole = graph.complete(ball, raw, filtered)
    a, b = numbered.select(F.col("title").alias("src"), F.col("id").alias("a")), numbered.select(F.col("title").alias("dst"), F.col("id").alias("b"))
    ids = graph.canonical(whole.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    edges = written(graph.prune(written(ids, "edges"), settings.min_links, settings.prune_quantile), "pruned")
    left = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return numbered.withColumnRenamed("id", "node").join(left, "node", "left_semi"), edges


def run(nodes: DataFrame, edges: DataFrame, categories: DataFrame, start: str, settings: Settings | None = None) -> Result:
    """From a graph (``node, title`` and canonical edges) and ``title, categories`` to the four reports."""
    settings = settings or Settings()
    pairs = written(similarity.pairs(edges), "pairs")
    parts = written(density.components(edges.select(F.col("src").alias("i"), F.col("dst").alias("j")), nodes), "parts")
    clusters = written(sweep.cluster(similarity.Affinity(edges, pairs), nodes, parts=parts), "clusters")
    cuts = similarity.thresholds(pairs, settings.weak, settings.strong)
    found = written(candidates.candidates(pairs, clusters, cuts.select("weak").scalar(), cuts.select("strong").scalar()), "candidates")
    cats = categories.select("title", text.category_set(F.col("categories"), settings.category_blacklist).alias("cats"))
    known = nodes.join(cats, "title", "left").join(clusters, "node").select("node", "title", F.coalesce("cats", F.array().cast("array<string>")).alias("cats"), "cluster")

    drawn = features.sample_pairs(edges.sparkSession, nodes, found.where("similarity > 0"), settings.train_pairs)
    train = written(features.build(drawn, known, edges, pairs, True, ("k",)), "train")
    fit_on, test = model.split(train, "k")
    ratio = model.class_ratio(fit_on).first()["ratio"] or 1.0
    weigh = lambda df: df.withColumn("weight", F.when(F.col("link") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))
    params, best, _ = model.tune(weigh(train if settings.leaky else fit_on), FEATURES, settings.space, estimator=lambda p: model.gbt(p, weight="weight"), n_splits=settings.n_splits, n_repeats=settings.n_repeats)
    tested = model.scored(best, model.assembled(test, FEATURES))

    rows = features.build(found.where("similarity > 0").select("i", "j"), known, edges, pairs, False, ("i", "j"))
    scored = written(model.scored(best, model.assembled(rows, FEATURES)).select("i", "j", "node_1", "node_2", "link_probability", "similarity", "cluster_node_1", "cluster_node_2"), "scored")
    home = known.where(F.col("title") == start).select("cluster").first()
    reports = {
        "overall": report.overall(scored, settings.cut, settings.rows),
        "start_cluster": report.of_cluster(scored, home["cluster"] if home else None, settings.cut, settings.rows),
        "start_node": report.of_node(scored, start, settings.cut, settings.rows),
        "across_clusters": report.across_clusters(scored, settings.cut, settings.rows),
    }
    return Result(edges, pairs, clusters, found, scored, model.metrics(tested), model.confusion(tested), params, reports)
