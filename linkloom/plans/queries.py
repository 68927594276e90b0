"""One query for each operator over the test tables, and the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import candidates as cand
from linkloom.operators import features, graph, model, report, similarity
from linkloom.operators.cluster import density, sweep, tree
from linkloom.plans import link_prediction
from linkloom.scratch import written
from linkloom.sources import graphs

START, DEPTH = 0, 2
PART_WORDS = ["widget", "small"]
#: Drawn pairs for the model's queries, which fit few and small trees: a fit is what the whole grid has 25 of.
MODEL_DRAWN, MODEL_GRID = 3000, {"n_estimators": [3], "max_depth": [2, 3]}


def _edges(spark, sf):
    return graphs.returned_together(spark, sf)


def _pairs(spark, sf):
    return similarity.pairs(written(_edges(spark, sf), "edges"))


def _nodes(spark, sf):
    return graphs.part_nodes(spark, sf)


def _candidates(spark, sf, pairs=None, **more):
    pairs = written(_pairs(spark, sf), "pairs") if pairs is None else pairs
    cuts = similarity.thresholds(pairs)
    return cand.candidates(pairs, _nodes(spark, sf), cuts.select("weak").scalar(), cuts.select("strong").scalar(), **more)


def _linked_nodes(edges):
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _known(spark, sf):
    return _nodes(spark, sf).select("node", "title", text.category_set(F.col("categories"), PART_WORDS).alias("cats"), "cluster")


def _distance(spark, sf):
    return similarity.distance(similarity.affinity(written(_pairs(spark, sf), "pairs")))


def _features(spark, sf, train, keep=()):
    edges = written(_edges(spark, sf), "edges")
    pairs = written(similarity.pairs(edges), "pairs")
    found = written(_candidates(spark, sf, pairs), "candidates")
    chosen = features.sample_pairs(spark, _linked_nodes(edges), found) if train else found.where("similarity > 0").select("i", "j")
    return features.build(chosen, _known(spark, sf), edges, pairs, train, keep)


def _judged(spark, sf):
    """Labelled documents with a made-up prediction and score, for the metrics."""
    score = F.round(model.draw(F.col("doc_id"), "score") * 0.5 + F.col("quality") * 0.3, 3)
    return graphs.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("link"), score.alias("score")).withColumn("predicted", F.expr("cast(score > 0.4D as int)"))


def _stand_in_scores(spark, sf):
    """Candidates with a fixed function of their features in place of a model."""
    rows = _features(spark, sf, False, ("i", "j"))
    value = F.round(0.3 + 2.0 * F.col("similarity") + 0.05 * F.col("common_categories"), 9)
    return rows.select("i", "j", "node_1", "node_2", F.least(value, F.lit(0.999)).alias("link_probability"), "similarity", "cluster_node_1", "cluster_node_2")


def edges_canonical(spark, sf):
    return _edges(spark, sf)


def adjacency_symmetric(spark, sf):
    return graph.adjacency(_edges(spark, sf))


def page_links_exploded(spark, sf):
    return graphs.page_links(graphs.table(spark, sf, "pages"))


def link_lists(spark, sf):
    lists = graphs.link_lists(graphs.page_links(graphs.table(spark, sf, "pages")))
    return lists.select("title", F.size("links").alias("n_links"), F.concat_ws(" ", "links").alias("links"))


def link_blacklist_filter(spark, sf):
    return text.without_substrings(graphs.page_links(graphs.table(spark, sf, "pages")), "link", text.LINK_BLACKLIST + ["th"])


def word_blacklist_filter(spark, sf):
    return text.without_words(graphs.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", PART_WORDS)


def category_charset_strip(spark, sf):
    own = graphs.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Category:"), "p_type").alias("raw"))
    return own.select("p_partkey", text.strip_category(F.col("raw")).alias("category"), text.strip_category(F.col("raw"), True).alias("strict"))


def category_sets(spark, sf):
    return _known(spark, sf).select("node", F.size("cats").alias("n"), F.concat_ws("|", F.array_sort("cats")).alias("cats"))


def node_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


def degree_quantile(spark, sf):
    return graph.degree_threshold(_edges(spark, sf))


def degree_prune(spark, sf):
    return graph.prune(written(_edges(spark, sf), "edges"))


def bfs_ball_depth2(spark, sf):
    return graph.ball(written(graph.adjacency(_edges(spark, sf)), "adjacency"), START, DEPTH)


def induced_subgraph(spark, sf):
    links = written(graph.adjacency(_edges(spark, sf)), "adjacency")
    ball = written(graph.ball(links, START, DEPTH), "ball")
    return graph.complete(ball, links, links)


def frontier_unfetched(spark, sf):
    links = written(graph.adjacency(_edges(spark, sf)), "adjacency")
    ball = written(graph.ball(links, START, DEPTH), "ball")
    return graph.unfetched(ball, ball.where(F.col("bfs_depth") < DEPTH)).select("node", "bfs_depth")


def common_neighbors(spark, sf):
    return similarity.common_neighbors(written(_edges(spark, sf), "edges"))


def total_neighbors(spark, sf):
    return _pairs(spark, sf).select("i", "j", "total")


def jaccard(spark, sf):
    return _pairs(spark, sf).select("i", "j", "similarity")


def affinity_distance(spark, sf):
    return _distance(spark, sf)


def similarity_thresholds(spark, sf):
    return similarity.thresholds(_pairs(spark, sf))


def weak_candidates(spark, sf):
    return _candidates(spark, sf, rule="weak")


def strong_candidates(spark, sf):
    return _candidates(spark, sf, rule="strong")


def missing_link_candidates(spark, sf):
    return _candidates(spark, sf)


def candidates_specific_cluster(spark, sf):
    return _candidates(spark, sf, specific_cluster=3)


def candidates_specific_node(spark, sf):
    return _candidates(spark, sf, specific_node=7)


def top_k_candidates(spark, sf):
    return cand.top(_candidates(spark, sf, rule="strong"), 20)


def train_pair_sample(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    found = written(_candidates(spark, sf, written(similarity.pairs(edges), "pairs")), "candidates")
    return features.sample_pairs(spark, _linked_nodes(edges), found)


def features_candidates(spark, sf):
    return _features(spark, sf, False)


def features_train(spark, sf):
    return _features(spark, sf, True, ("k",))


def category_overlap(spark, sf):
    own = _known(spark, sf)
    a, b = own.select(F.col("node").alias("src"), F.col("cats").alias("a")), own.select(F.col("node").alias("dst"), F.col("cats").alias("b"))
    both = _edges(spark, sf).join(a, "src").join(b, "dst")
    return both.select("src", "dst", F.size(F.array_intersect("a", "b")).alias("common_categories"), F.size(F.array_union("a", "b")).alias("total_categories"))


def class_ratio(spark, sf):
    return model.class_ratio(_judged(spark, sf)).select(F.round("ratio", 9).alias("ratio"))


def train_test_split(spark, sf):
    train, test = model.split(_judged(spark, sf), "doc_id")
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(test.select("doc_id", F.lit("test").alias("part")))


def stratified_folds(spark, sf):
    return model.folds(_judged(spark, sf), "doc_id", "link", 5).select("doc_id", "link", "fold")


def param_grid(spark, sf):
    return model.param_rows(spark, model.GRID)


def _cv_table(spark):
    grid = model.param_rows(spark, model.GRID).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    return grid.withColumn("score", F.col("max_depth") / 10 + F.col("n_estimators") / 1000 + F.col("fold") / 100)


def hyperparam_marginals(spark, sf):
    return model.marginals(_cv_table(spark), list(model.GRID)).select("param", "value", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def confusion_matrix(spark, sf):
    return model.confusion(_judged(spark, sf))


def classification_metrics(spark, sf):
    return model.metrics(_judged(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc_hard")))


def roc_curve(spark, sf):
    return model.roc_curve(_judged(spark, sf), "score").select("threshold", "tp", "fp", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def youden_threshold(spark, sf):
    return model.youden(model.roc_curve(_judged(spark, sf), "score")).select("threshold", F.round("j", 9).alias("j"))


def core_distance(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    dist = written(similarity.distance(similarity.affinity(similarity.pairs(edges))), "distance")
    return density.core_distances(dist, _linked_nodes(edges)).select("node", F.round("core", 9).alias("core"))


def mutual_reachability(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    dist = written(similarity.distance(similarity.affinity(similarity.pairs(edges))), "distance")
    reach = density.mutual_reachability(dist, density.core_distances(dist, _linked_nodes(edges)))
    return reach.select("i", "j", F.round("d", 9).alias("d"))


def _tree(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    nodes = _linked_nodes(edges)
    dist = written(similarity.distance(similarity.affinity(similarity.pairs(edges))), "distance")
    reach = density.mutual_reachability(dist, density.core_distances(dist, nodes))
    return density.spanning_tree(reach, nodes), nodes


def _parts(edges, nodes):
    """Nodes by what the edges join: a pair with a common neighbour is in one part."""
    return written(density.components(edges.select(F.col("src").alias("i"), F.col("dst").alias("j")), nodes), "parts")


def mst_edges(spark, sf):
    return _tree(spark, sf)[0]


def hdbscan_labels(spark, sf):
    found, nodes = _tree(spark, sf)
    return tree.labels(found, nodes, [0.5]).select("node", "cluster")


def epsilon_sweep(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    nodes = written(_linked_nodes(edges), "nodes")
    return sweep.sweep(similarity.Affinity(edges), nodes, parts=_parts(edges, nodes))[0]


def noise_recluster(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    nodes = written(_linked_nodes(edges), "nodes")
    return sweep.cluster(similarity.Affinity(edges), nodes, epsilons=[0.3, 0.6, 0.9], parts=_parts(edges, nodes))


def silhouette_rows(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    nodes = written(_linked_nodes(edges).join(_nodes(spark, sf).select("node", "cluster"), "node"), "nodes")
    return sweep.silhouettes(similarity.Affinity(edges), nodes.withColumn("epsilon", F.lit(0.0)), parts=_parts(edges, nodes)).select(F.round("silhouette", 6).alias("silhouette"))


def cluster_sizes(spark, sf):
    return report.cluster_sizes(_nodes(spark, sf).select("node", "cluster"))


def start_cluster_members(spark, sf):
    return report.cluster_members(_nodes(spark, sf).select("node", "cluster"), START)


def gbt_grid_search(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    pairs = written(similarity.pairs(edges), "pairs")
    rows = features.build(_balanced(spark, edges, _candidates(spark, sf, pairs)), _known(spark, sf), edges, pairs, True, ("k",))
    return model.tune(written(rows, "train"), link_prediction.FEATURES, MODEL_GRID, n_splits=2, n_repeats=1)[2]


def _balanced(spark, edges, found):
    """Drawn pairs and edges, for a model over few rows."""
    drawn = features.sample_pairs(spark, _linked_nodes(edges), found, MODEL_DRAWN)
    linked = edges.select(F.xxhash64("src", "dst").bitwiseOR(F.lit(1 << 62)).alias("k"), F.col("src").alias("i"), F.col("dst").alias("j"))
    return drawn.unionByName(linked)


def link_predictions(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    pairs = written(similarity.pairs(edges), "pairs")
    found = written(_candidates(spark, sf, pairs), "candidates")
    train = written(features.build(_balanced(spark, edges, found), _known(spark, sf), edges, pairs, True, ("k",)), "train")
    fitted = model.gbt({"n_estimators": 5, "max_depth": 3}).fit(model.assembled(train, link_prediction.FEATURES))
    rows = features.build(found.select("i", "j"), _known(spark, sf), edges, pairs, False, ("i", "j"))
    out = model.scored(fitted, model.assembled(rows, link_prediction.FEATURES))
    return out.select("i", "j", "node_1", "node_2", "link_probability", "similarity", "cluster_node_1", "cluster_node_2")


def link_analysis(spark, sf):
    """The whole analysis with its own clusters and model: the report over all pairs."""
    edges = written(_edges(spark, sf), "edges")
    parts = _nodes(spark, sf).withColumn("title", F.concat_ws(" ", "title", "node"))  # names of parts aren't unique
    nodes = parts.join(_linked_nodes(edges), "node", "left_semi").select("node", "title")
    settings = link_prediction.Settings(category_blacklist=PART_WORDS, train_pairs=100 * MODEL_DRAWN, space=MODEL_GRID)
    first = nodes.orderBy("node").limit(1).first()
    return link_prediction.run(nodes, edges, parts.select("title", "categories"), first["title"] if first else "", settings).reports["overall"]


def page_categories(spark, sf):
    raw = graphs.table(spark, sf, "part").select(F.col("p_partkey").alias("title"), F.array(F.concat(F.lit("Category:"), "p_type"), F.concat(F.lit("Category:"), "p_brand")).alias("categories"))
    return graphs.page_categories(raw)


def report_overall(spark, sf):
    return report.overall(_stand_in_scores(spark, sf))


def report_start_cluster(spark, sf):
    home = _nodes(spark, sf).where(F.col("node") == START).first()
    return report.of_cluster(_stand_in_scores(spark, sf), home["cluster"] if home else None)


def report_start_node(spark, sf):
    scored = _stand_in_scores(spark, sf)
    return report.of_node(scored, _nodes(spark, sf).where("node = 7").first()["title"])


def report_cross_cluster(spark, sf):
    return report.across_clusters(_stand_in_scores(spark, sf))


def graph_stats(spark, sf):
    return graph.stats(_edges(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        edges_canonical, adjacency_symmetric, page_links_exploded, link_lists, link_blacklist_filter, word_blacklist_filter, category_charset_strip, category_sets, node_degrees, degree_quantile,
        degree_prune, bfs_ball_depth2, induced_subgraph, frontier_unfetched, common_neighbors, total_neighbors, jaccard, affinity_distance, similarity_thresholds, weak_candidates,
        strong_candidates, missing_link_candidates, candidates_specific_cluster, candidates_specific_node, top_k_candidates, train_pair_sample, features_candidates, features_train, category_overlap,
        class_ratio, train_test_split, stratified_folds, param_grid, hyperparam_marginals, confusion_matrix, classification_metrics, roc_curve, youden_threshold, core_distance, mutual_reachability, mst_edges,
        hdbscan_labels, epsilon_sweep, noise_recluster, silhouette_rows, cluster_sizes, start_cluster_members, gbt_grid_search, link_predictions, page_categories, report_overall, report_start_cluster, report_start_node,
        report_cross_cluster, graph_stats, link_analysis,
    )
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar pairs that aren't linked, above the strong threshold."""
    return top_k_candidates(spark, sf)


_GRAPH = """WITH RECURSIVE ret AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
edges AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM ret a JOIN ret b ON a.o = b.o AND a.p < b.p),
adj AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT src AS node, count(*) AS degree FROM adj GROUP BY src),
linked AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM deg)"""
_PAIRS = f"""{_GRAPH},
common AS (SELECT x.src AS i, y.dst AS j, count(*) AS common FROM adj x JOIN adj y ON x.dst = y.src AND x.src < y.dst GROUP BY 1, 2),
stored AS (SELECT coalesce(c.i, e.src) AS i, coalesce(c.j, e.dst) AS j, coalesce(c.common, 0) AS common, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS adj FROM common c FULL JOIN edges e ON c.i = e.src AND c.j = e.dst),
totals AS (SELECT i, j, common, adj, a.degree + b.degree - common - 2 * adj AS total FROM stored JOIN deg a ON a.node = i JOIN deg b ON b.node = j),
pairs AS (SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE common::DOUBLE / total::DOUBLE END AS similarity FROM totals),
cuts AS (SELECT round(quantile_cont(similarity, 0.75), 12) AS weak, round(quantile_cont(similarity, 0.95), 12) AS strong FROM (SELECT similarity FROM pairs WHERE adj = 1 UNION ALL SELECT similarity FROM pairs WHERE adj = 1)),
parts AS (SELECT p_partkey AS node, p_name AS title, list_concat([p_type, p_brand], string_split(p_name, ' ')) AS raw, CASE WHEN p_size > 45 THEN -1 ELSE p_size % 8 END::INTEGER AS cluster FROM part),
known AS (SELECT node, title, list_distinct([c FOR c IN raw IF NOT (contains(lower(c), 'widget') OR contains(lower(c), 'small'))]) AS cats, cluster FROM parts),
open_pairs AS (SELECT p.i, p.j, p.similarity, a.cluster AS ci, b.cluster AS cj FROM pairs p JOIN parts a ON a.node = p.i JOIN parts b ON b.node = p.j WHERE adj = 0),
ruled AS (SELECT i, j, similarity, ci, cj, ci = cj AND ci >= 0 AND round(similarity, 12) >= weak AS weak, round(similarity, 12) > strong AS strong FROM open_pairs, cuts),
cand AS (SELECT i, j, similarity FROM ruled WHERE weak OR strong)"""
_DISTANCE = f"""{_PAIRS},
top AS (SELECT max(similarity + adj) AS m FROM pairs),
dist AS MATERIALIZED (SELECT i, j, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE 1 - (similarity + adj) / m END AS d FROM pairs, top),
both_ways AS (SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist),
ranked AS MATERIALIZED (SELECT i AS node, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM both_ways),
core AS MATERIALIZED (SELECT l.node, least(coalesce(k.d, 1.0::DOUBLE), 1.0::DOUBLE) AS core FROM linked l LEFT JOIN (SELECT node, d FROM ranked WHERE r = 4) k ON k.node = l.node)"""
#: Every two nodes' distance is that of their rows of similarities, scaled, with 1 for a node's own.
_SILHOUETTE = f"""{_DISTANCE},
cells AS MATERIALIZED (SELECT i AS row, j AS col, 1 - d AS v FROM both_ways UNION ALL SELECT node, node, 1.0::DOUBLE FROM linked),
squares AS (SELECT row, sum(v * v) AS s, any_value(p.cluster) AS cluster FROM cells JOIN parts p ON p.node = row GROUP BY row),
dots AS (SELECT a.row AS x, b.row AS y, sum(a.v * b.v) AS dot FROM cells a JOIN cells b ON a.col = b.col GROUP BY 1, 2),
apart AS (SELECT a.row AS x, a.cluster AS own, b.cluster AS other, sum(sqrt(greatest(a.s + b.s - 2 * coalesce(dot, 0), 0))) AS total, count(*) AS n FROM squares a JOIN squares b ON a.row <> b.row LEFT JOIN dots ON x = a.row AND y = b.row GROUP BY ALL),
sides AS (SELECT x, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM apart GROUP BY x)"""


def _boruvka(rounds: int = 12, jumps: int = 8) -> str:
    """The spanning tree's rounds written out: the least edge of each component, hooks without their cycles, jumps to the root."""
    parts = ["reach AS MATERIALIZED (SELECT * FROM (SELECT i, j, greatest(d, a.core, b.core) AS d FROM dist JOIN core a ON a.node = i JOIN core b ON b.node = j) WHERE d < 1)", "l0 AS (SELECT node, node AS c FROM linked)"]
    for r in range(rounds):
        parts += [
            f"o{r} AS MATERIALIZED (SELECT a.c AS a, b.c AS b, d, i, j FROM reach JOIN l{r} a ON a.node = i JOIN l{r} b ON b.node = j WHERE a.c <> b.c)",
            f"m{r} AS MATERIALIZED (SELECT * FROM (SELECT a AS c, b AS p, d, i, j FROM o{r} UNION ALL SELECT b, a, d, i, j FROM o{r}) QUALIFY row_number() OVER (PARTITION BY c ORDER BY d, i, j) = 1)",
            f"j{r}_0 AS MATERIALIZED (SELECT m.c, CASE WHEN n.p = m.c AND m.c < m.p THEN m.c ELSE m.p END AS p FROM m{r} m JOIN m{r} n ON n.c = m.p)",
            *(f"j{r}_{k + 1} AS MATERIALIZED (SELECT x.c, y.p FROM j{r}_{k} x JOIN j{r}_{k} y ON y.c = x.p)" for k in range(jumps)),
            f"l{r + 1} AS MATERIALIZED (SELECT node, coalesce(y.p, l.c) AS c FROM l{r} l LEFT JOIN j{r}_{jumps} y ON y.c = l.c)",
        ]
    heads = f"heads AS (SELECT min(node) AS head FROM l{rounds} GROUP BY c)"
    joined = "SELECT (SELECT min(head) FROM heads) AS i, head AS j, 1.0::DOUBLE AS d FROM heads WHERE head > (SELECT min(head) FROM heads)"
    return f"{_DISTANCE}, {', '.join(parts)}, {heads} {' UNION '.join(f'SELECT i, j, d FROM m{r}' for r in range(rounds))} UNION ALL {joined}"


_BALL = f"""{_GRAPH},
walk AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT a.dst, w.depth + 1 FROM walk w JOIN adj a ON a.src = w.node WHERE w.depth < 2),
ball AS (SELECT node, min(depth)::INTEGER AS bfs_depth FROM walk GROUP BY node)"""
_MD5 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


#: Keys of drawn pairs are five for each candidate, a million at least; so many always leave as many pairs as candidates here.
_SAMPLED = f"""keys AS (SELECT unnest(range((SELECT greatest(5 * count(*), 1000000) FROM cand))) AS k),
draws AS (SELECT k, {_MD5.format("'i' || k")} % (SELECT count(*) FROM linked) AS a, {_MD5.format("'j' || k")} % (SELECT count(*) FROM linked) AS b FROM keys),
drawn AS (SELECT k, x.node AS i, y.node AS j FROM draws JOIN linked x ON x.idx = a JOIN linked y ON y.idx = b),
sampled AS (SELECT k, i, j FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.i = d.i AND c.j = d.j))"""


_FEATURES = """a.title AS node_1, b.title AS node_2, da.degree AS degree_node_1, db.degree AS degree_node_2, coalesce(p.common, 0) AS common_neighbors,
CASE WHEN s.i = s.j THEN 1 ELSE coalesce(p.total, da.degree + db.degree) END AS total_neighbors, coalesce(p.similarity, 0.0::DOUBLE) AS similarity,
len(list_intersect(a.cats, b.cats))::INTEGER AS common_categories, len(list_distinct(list_concat(a.cats, b.cats)))::INTEGER AS total_categories,
len(a.cats)::INTEGER AS n_categories_node_1, len(b.cats)::INTEGER AS n_categories_node_2, a.cluster AS cluster_node_1, b.cluster AS cluster_node_2"""
_FROM = """FROM {0} s JOIN known a ON a.node = s.i JOIN known b ON b.node = s.j JOIN deg da ON da.node = s.i JOIN deg db ON db.node = s.j
LEFT JOIN pairs p ON p.i = least(s.i, s.j) AND p.j = greatest(s.i, s.j)"""
_SCORED = f"""{_PAIRS}, feats AS (SELECT s.i, s.j, {_FEATURES} {_FROM.format("(SELECT * FROM cand WHERE similarity > 0)")}),
scored AS (SELECT i, j, node_1, node_2, least(round(0.3::DOUBLE + 2.0::DOUBLE * similarity + 0.05::DOUBLE * common_categories, 9), 0.999::DOUBLE) AS link_probability, similarity, cluster_node_1, cluster_node_2 FROM feats),
good AS (SELECT * FROM scored WHERE link_probability > 0.5)"""
_TOP = "ORDER BY link_probability DESC, i, j LIMIT 100"
_JUDGED = f"""WITH base AS (SELECT doc_id, quality AS link, round({_MD5.format("'score' || doc_id")} / 4294967296.0::DOUBLE * 0.5::DOUBLE + quality * 0.3::DOUBLE, 3) AS score FROM labels),
judged AS (SELECT *, CASE WHEN score > 0.4::DOUBLE THEN 1 ELSE 0 END AS predicted FROM base)"""
_ROC = f"""{_JUDGED},
by_score AS (SELECT score AS threshold, sum(CASE WHEN link = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN link = 0 THEN 1 ELSE 0 END) AS n FROM judged GROUP BY score),
curve AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, (sum(p) OVER w)::DOUBLE / (SELECT sum(p) FROM by_score) AS tpr, (sum(n) OVER w)::DOUBLE / (SELECT sum(n) FROM by_score) AS fpr FROM by_score WINDOW w AS (ORDER BY threshold DESC))"""
_HREFS = "SELECT page_id AS title, unnest(generate_series(0, len(h) - 1))::INTEGER AS pos, unnest(h) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)"
_GRID = "SELECT n.v::DOUBLE AS n_estimators, d.v::DOUBLE AS max_depth, a.v::DOUBLE AS alpha FROM (VALUES (100), (200)) n(v), (VALUES (3), (5), (7)) d(v), (VALUES (0), (0.1)) a(v)"
_CV = f"WITH cv AS (SELECT *, max_depth / 10 + n_estimators / 1000 + f / 100.0::DOUBLE AS score FROM ({_GRID}), (VALUES (0), (1)) x(f))"

ORACLE_SQL = {
    "edges_canonical": f"{_GRAPH} SELECT src, dst FROM edges",
    "adjacency_symmetric": f"{_GRAPH} SELECT src, dst FROM adj",
    "page_links_exploded": _HREFS,
    "link_lists": f"SELECT title, count(*)::INTEGER AS n_links, string_agg(link, ' ' ORDER BY pos) AS links FROM ({_HREFS}) GROUP BY title",
    "link_blacklist_filter": f"SELECT * FROM ({_HREFS}) WHERE NOT ({' OR '.join(f"contains(lower(link), '{w}')" for w in [*text.LINK_BLACKLIST, 'th'])})",
    "word_blacklist_filter": "SELECT p_partkey, lower(p_name) AS p_name FROM part WHERE NOT list_has_any(regexp_split_to_array(trim(lower(p_name)), '\\s+'), ['widget', 'small'])",
    "category_charset_strip": "SELECT p_partkey, ltrim('Category:' || p_type, 'Category:') AS category, p_type AS strict FROM part",
    "page_categories": "SELECT p_partkey AS title, u.pos, ltrim(u.raw, 'Category:') AS category FROM part, (VALUES (0), (1)) n(pos), LATERAL (SELECT n.pos::INTEGER AS pos, 'Category:' || CASE WHEN n.pos = 0 THEN p_type ELSE p_brand END AS raw) u",
    "category_sets": f"{_PAIRS} SELECT node, len(cats)::INTEGER AS n, array_to_string(list_sort(cats), '|') AS cats FROM known",
    "node_degrees": f"{_GRAPH} SELECT node, degree FROM deg",
    "degree_quantile": f"{_GRAPH} SELECT q AS quantile, trunc(least(15.0::DOUBLE, q))::INTEGER AS threshold FROM (SELECT round(quantile_cont(degree::DOUBLE, 0.33), 12) AS q FROM deg)",
    "degree_prune": f"{_GRAPH}, cut AS (SELECT trunc(least(15.0::DOUBLE, quantile_cont(degree::DOUBLE, 0.33)))::INTEGER AS t FROM deg), kept AS (SELECT node FROM deg, cut WHERE degree >= t) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)",
    "bfs_ball_depth2": f"{_BALL} SELECT b.node, b.bfs_depth, (SELECT min(a.src) FROM adj a JOIN ball c ON c.node = a.src AND c.bfs_depth = b.bfs_depth - 1 WHERE a.dst = b.node) AS parent FROM ball b",
    "induced_subgraph": f"{_BALL} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM ball) AND dst IN (SELECT node FROM ball)",
    "frontier_unfetched": f"{_BALL} SELECT node, bfs_depth FROM ball WHERE bfs_depth = 2",
    "common_neighbors": f"{_PAIRS} SELECT i, j, common FROM common",
    "total_neighbors": f"{_PAIRS} SELECT i, j, total::BIGINT AS total FROM pairs",
    "jaccard": f"{_PAIRS} SELECT i, j, similarity FROM pairs",
    "affinity_distance": f"{_DISTANCE} SELECT i, j, d FROM dist",
    "similarity_thresholds": f"{_PAIRS} SELECT weak, strong FROM cuts",
    "weak_candidates": f"{_PAIRS} SELECT i, j, similarity FROM ruled WHERE weak",
    "strong_candidates": f"{_PAIRS} SELECT i, j, similarity FROM ruled WHERE strong",
    "missing_link_candidates": f"{_PAIRS} SELECT i, j, similarity FROM cand",
    "candidates_specific_cluster": f"{_PAIRS} SELECT i, j, similarity FROM ruled WHERE (weak AND ci = 3) OR strong",
    "candidates_specific_node": f"{_PAIRS} SELECT i, j, similarity FROM ruled WHERE (weak AND (i = 7 OR j = 7)) OR strong",
    "top_k_candidates": f"{_PAIRS} SELECT i, j, similarity FROM ruled WHERE strong ORDER BY similarity DESC, i, j LIMIT 20",
    "train_pair_sample": f"{_PAIRS}, {_SAMPLED} SELECT k, i, j FROM sampled",
    "features_candidates": f"{_PAIRS} SELECT {_FEATURES} {_FROM.format('(SELECT * FROM cand WHERE similarity > 0)')}",
    "features_train": f"{_PAIRS}, {_SAMPLED} SELECT s.k, {_FEATURES}, coalesce(p.adj, 0) AS link {_FROM.format('sampled')}",
    "category_overlap": f"{_PAIRS} SELECT src, dst, len(list_intersect(a.cats, b.cats))::INTEGER AS common_categories, len(list_distinct(list_concat(a.cats, b.cats)))::INTEGER AS total_categories FROM edges JOIN known a ON a.node = src JOIN known b ON b.node = dst",
    "class_ratio": f"{_JUDGED} SELECT round(sum(CASE WHEN link = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE / nullif(sum(link), 0), 9) AS ratio FROM judged",
    "train_test_split": f"{_JUDGED} SELECT doc_id, CASE WHEN {_MD5.format("'split42:' || doc_id")} / 4294967296.0::DOUBLE < 0.3::DOUBLE THEN 'test' ELSE 'train' END AS part FROM judged",
    "stratified_folds": f"{_JUDGED} SELECT doc_id, link, ((row_number() OVER (PARTITION BY link ORDER BY md5('fold1.0:' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM judged",
    "param_grid": _GRID,
    "hyperparam_marginals": f"{_CV} SELECT param, value, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std FROM (SELECT 'n_estimators' AS param, n_estimators AS value, score FROM cv UNION ALL SELECT 'max_depth', max_depth, score FROM cv UNION ALL SELECT 'alpha', alpha, score FROM cv) GROUP BY param, value",
    "confusion_matrix": f"{_JUDGED} SELECT link AS label, predicted, count(*) AS n FROM judged GROUP BY link, predicted",
    "classification_metrics": f"""{_JUDGED}, c AS (SELECT sum(CASE WHEN link = 1 AND predicted = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN link = 0 AND predicted = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN link = 1 AND predicted = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN link = 0 AND predicted = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn FROM judged)
SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS roc_auc_hard FROM c""",
    "roc_curve": f"{_ROC} SELECT threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM curve",
    "youden_threshold": f"{_ROC} SELECT threshold, round(tpr - fpr, 9) AS j FROM curve ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1",
    "core_distance": f"{_DISTANCE} SELECT node, round(core, 9) AS core FROM core",
    "mutual_reachability": f"{_DISTANCE} SELECT i, j, round(greatest(d, a.core, b.core), 9) AS d FROM dist JOIN core a ON a.node = i JOIN core b ON b.node = j",
    "mst_edges": _boruvka(),
    "silhouette_rows": f"{_SILHOUETTE} SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides",
    "cluster_sizes": "SELECT cluster, count(*) AS size FROM (SELECT CASE WHEN p_size > 45 THEN -1 ELSE p_size % 8 END::INTEGER AS cluster FROM part) GROUP BY cluster",
    "start_cluster_members": f"{_PAIRS} SELECT node, cluster FROM parts WHERE cluster = (SELECT cluster FROM parts WHERE node = 0)",
    "report_overall": f"{_SCORED} SELECT * FROM good {_TOP}",
    "report_start_cluster": f"{_SCORED} SELECT * FROM good WHERE cluster_node_1 = (SELECT cluster FROM parts WHERE node = 0) OR cluster_node_2 = (SELECT cluster FROM parts WHERE node = 0) {_TOP}",
    "report_start_node": f"{_SCORED} SELECT * FROM good WHERE node_1 = (SELECT title FROM parts WHERE node = 7) OR node_2 = (SELECT title FROM parts WHERE node = 7) {_TOP}",
    "report_cross_cluster": f"{_SCORED} SELECT * FROM good WHERE cluster_node_1 <> cluster_node_2 {_TOP}",
    "graph_stats": f"{_GRAPH} SELECT (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges",
}
