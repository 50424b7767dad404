"""Graph algorithms, self-organising maps and derived analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, som
from ..operators.closure import closure
from .registry import both, frame, view

PPR_ALPHA, PPR_ROUNDS, PPR_START = 0.15, 10, ("nation/1", "nation/2")


def _ppr_sql(edges: str, start: tuple[str, ...], rounds: int, top: str) -> str:
    """The walk, a round per table expression."""
    names = ", ".join(f"'{s}'" for s in start)
    steps = [
        f"two AS (SELECT a, b, max(weight) AS weight FROM (SELECT src AS a, dst AS b, weight FROM {edges} WHERE src <> dst UNION ALL SELECT dst, src, weight FROM {edges} WHERE src <> dst) u GROUP BY a, b)",
        "step AS (SELECT two.a, b, weight / total AS p FROM two JOIN (SELECT a, sum(weight) AS total FROM two GROUP BY a) t ON t.a = two.a)",
        f"home AS (SELECT node, CASE WHEN node IN ({names}) THEN 1.0 / {len(start)} ELSE 0.0 END * 1e0 AS home FROM (SELECT DISTINCT a AS node FROM two) n)",
        "r0 AS (SELECT node, home AS score FROM home)",
    ]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT h.node, {PPR_ALPHA} * h.home + (1 - {PPR_ALPHA}) * coalesce(m.got, 0) AS score FROM home h LEFT JOIN (SELECT s.b AS node, sum(r.score * s.p) AS got FROM r{k} r JOIN step s ON s.a = r.node GROUP BY s.b) m ON m.node = h.node)")
    return f"WITH {', '.join(steps)} {top.replace('LAST', f'r{rounds}')}"


both("graph_build", lambda d: "SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM kg_edges UNION ALL SELECT dst, 0, 1 FROM kg_edges) t GROUP BY node")
both("graph_stats", lambda d: "SELECT n, m, round(m / (CAST(n AS DOUBLE) * (n - 1) / 2), 9) AS density, round(mean_degree, 6) AS mean_degree, max_degree, round(total, 3) AS total_weight FROM (SELECT count(*) AS n FROM kg_nodes) a, (SELECT count(*) AS m, sum(weight) AS total FROM kg_edges) b, (SELECT avg(CAST(k AS DOUBLE)) AS mean_degree, max(k) AS max_degree FROM (SELECT a, count(*) AS k FROM kg_adj GROUP BY a) g) c")
LABEL_ROUNDS = 12


def _labels_sql(edges: str, rounds: int, top: str) -> str:
    """Smallest labels of neighbours, a round per table expression; enough for paths of as many edges."""
    steps = [f"two AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges})", "l0 AS (SELECT DISTINCT a AS node, a AS label FROM two)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS (SELECT l.node, least(l.label, m.label) AS label FROM l{k} l JOIN (SELECT two.a AS node, min(n.label) AS label FROM two JOIN l{k} n ON n.node = two.b GROUP BY two.a) m ON m.node = l.node)")
    return f"WITH {', '.join(steps)} {top.replace('LAST', f'l{rounds}')}"


frame("graph_components", lambda spark, sf: graph.components(view(spark, sf, "kg_edges")), lambda d: _labels_sql("kg_edges", LABEL_ROUNDS, "SELECT node, label AS component FROM LAST"))
frame(
    "graph_connected",
    lambda spark, sf: graph.components(view(spark, sf, "kg_edges")).agg((F.count_distinct("component") == 1).alias("connected")),
    lambda d: _labels_sql("kg_edges", LABEL_ROUNDS, "SELECT count(DISTINCT label) = 1 AS connected FROM LAST"),
)
CORE_ROUNDS = 12
#: Of the sampled betweenness: at most this part of the largest possible score.
ERROR, FAILURE, LEVELS = 0.2, 0.05, 12


def _core_ctes(edges: str, rounds: int) -> list[str]:
    """h-index rounds from the degrees, all nodes in every round."""
    out = [f"two AS MATERIALIZED (SELECT src AS a, dst AS b FROM {edges} WHERE src <> dst UNION SELECT dst, src FROM {edges} WHERE src <> dst)", "c0 AS MATERIALIZED (SELECT a AS node, count(*) AS core FROM two GROUP BY a)"]
    for k in range(rounds):
        counts = f"SELECT t.a AS node, least(o.core, n.core) AS v, count(*) AS n FROM two t JOIN c{k} n ON n.node = t.b JOIN c{k} o ON o.node = t.a GROUP BY t.a, least(o.core, n.core)"
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT node, max(least(v, reach)) AS core FROM (SELECT node, v, sum(n) OVER (PARTITION BY node ORDER BY v DESC) AS reach FROM ({counts}) x) y GROUP BY node)")
    return out


def _between_ctes(levels: int) -> list[str]:
    """Shortest paths from the sources level by level, and back; ``two`` holds the edges both ways."""
    out = [
        "nodes AS MATERIALIZED (SELECT DISTINCT a AS node FROM two)",
        f"asked AS (SELECT least(count(*), CAST(ceil((ln(greatest(count(*), 2)) + ln(2 / {FAILURE})) / (2 * {ERROR} * {ERROR})) AS BIGINT)) AS k, count(*) AS n FROM nodes)",
        "l0 AS MATERIALIZED (SELECT node AS source, node, 1e0 AS paths FROM (SELECT node, row_number() OVER (ORDER BY md5(node)) AS r FROM nodes) x, asked WHERE r <= k)",
    ]
    for k in range(levels):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{j}" for j in range(max(0, k - 1), k + 1))
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT l.source, t.b AS node, sum(paths) AS paths FROM l{k} l JOIN two t ON t.a = l.node LEFT JOIN ({seen}) s ON s.source = l.source AND s.node = t.b WHERE s.node IS NULL GROUP BY l.source, t.b)")
    out.append(f"o{levels} AS (SELECT source, node, paths, 0e0 AS owed FROM l{levels})")
    for k in range(levels - 1, 0, -1):
        out.append(f"o{k} AS MATERIALIZED (SELECT l.source, l.node, l.paths, l.paths * coalesce(x.share, 0) AS owed FROM l{k} l LEFT JOIN (SELECT o.source, t.b AS node, sum((1 + owed) / paths) AS share FROM o{k + 1} o JOIN two t ON t.a = o.node GROUP BY o.source, t.b) x ON x.source = l.source AND x.node = l.node)")
    every = " UNION ALL ".join(f"SELECT node, owed FROM o{k}" for k in range(1, levels + 1))
    out.append(f"between AS (SELECT n.node, coalesce(x.owed, 0) * 2 / ((n.n - 1e0) * (n.n - 2)) * n.n / n.k AS score FROM (SELECT * FROM nodes, asked) n LEFT JOIN (SELECT node, sum(owed) AS owed FROM ({every}) o GROUP BY node) x ON x.node = n.node)")
    return out


frame("graph_kcore", lambda spark, sf: graph.k_core(view(spark, sf, "kg_edges")), lambda d: f"WITH {', '.join(_core_ctes('kg_edges', CORE_ROUNDS))} SELECT node, core FROM c{CORE_ROUNDS}")
frame("graph_ppr", lambda spark, sf: graph.personalised_pagerank(view(spark, sf, "kg_edges"), list(PPR_START), alpha=PPR_ALPHA, rounds=PPR_ROUNDS).select("node", F.round("score", 6).alias("score")), lambda d: _ppr_sql("kg_edges", PPR_START, PPR_ROUNDS, "SELECT node, round(score, 6) AS score FROM LAST"))
frame(
    "graph_ppr_topk_type",
    lambda spark, sf: graph.personalised_pagerank(view(spark, sf, "kg_edges"), list(PPR_START), alpha=PPR_ALPHA, rounds=PPR_ROUNDS)
    .where(~F.col("node").isin(*PPR_START) & (F.col("score") > 0)).join(view(spark, sf, "SELECT uri AS node, type FROM kg_nodes"), "node").groupBy("type").agg(F.round(F.max("score"), 6).alias("best"), F.count("*").alias("n")),
    lambda d: _ppr_sql("kg_edges", PPR_START, PPR_ROUNDS, f"SELECT type, round(max(r.score), 6) AS best, count(*) AS n FROM LAST r JOIN kg_nodes k ON k.uri = r.node WHERE r.node NOT IN {PPR_START} AND r.score > 0 GROUP BY type"),
)
frame(
    "ppr_combine",
    lambda spark, sf: graph.personalised_pagerank(view(spark, sf, "kg_edges"), ["nation/1"], rounds=4).unionByName(graph.personalised_pagerank(view(spark, sf, "kg_edges"), ["nation/7"], rounds=4)).groupBy("node").agg(F.round(F.avg("score"), 6).alias("score")),
    lambda d: f"SELECT node, round(avg(score), 6) AS score FROM (({_ppr_sql('kg_edges', ('nation/1',), 4, 'SELECT node, score FROM LAST')}) UNION ALL ({_ppr_sql('kg_edges', ('nation/7',), 4, 'SELECT node, score FROM LAST')})) u GROUP BY node",
)
frame(
    "graph_betweenness", lambda spark, sf: graph.betweenness(view(spark, sf, "kg_edges"), error=ERROR).select("node", F.round("score", 6).alias("score")),
    lambda d: f"WITH {', '.join(_core_ctes('kg_edges', 0)[:1] + _between_ctes(LEVELS))} SELECT node, round(score, 6) AS score FROM between",
)
frame(
    "score_entity_importance",
    lambda spark, sf: graph.importance(view(spark, sf, "kg_edges"), error=ERROR).select("node", F.round("importance", 6).alias("importance")).orderBy(F.desc("importance"), "node").limit(20),
    lambda d: f"WITH {', '.join(_core_ctes('kg_edges', CORE_ROUNDS) + _between_ctes(LEVELS))}, parts AS (SELECT d.node, d.core AS degree, c.core, b.score FROM c0 d JOIN c{CORE_ROUNDS} c ON c.node = d.node JOIN between b ON b.node = d.node), top AS (SELECT max(degree) AS d, max(core) AS c, max(score) AS b FROM parts) SELECT node, round(0.4e0 * degree / d + 0.4e0 * core / c + CASE WHEN b > 0 THEN 0.2e0 * score / b ELSE 0 END, 6) AS importance FROM parts, top ORDER BY importance DESC, node LIMIT 20",
)
frame("graph_communities", lambda spark, sf: graph.communities(view(spark, sf, "kg_edges")))
#: Region of every node: its own, its nation's, or of parts that of the first of their suppliers.
_MEMBERS = (
    "SELECT src AS node, dst AS community FROM kg_edges WHERE type = 'inRegion' UNION ALL SELECT a.src, b.dst FROM kg_edges a JOIN kg_edges b ON a.dst = b.src WHERE a.type IN ('basedIn', 'livesIn') UNION ALL SELECT DISTINCT dst, dst FROM kg_edges WHERE type = 'inRegion' "
    "UNION ALL SELECT p.part, b.dst FROM (SELECT src AS part, min(dst) AS first FROM kg_edges WHERE type = 'suppliedBy' GROUP BY src) p JOIN kg_edges a ON a.src = p.first AND a.type = 'basedIn' JOIN kg_edges b ON b.src = a.dst"
)
frame(
    "graph_modularity",
    lambda spark, sf: graph.modularity(view(spark, sf, "kg_edges"), view(spark, sf, _MEMBERS)).select(F.round("q", 6).alias("q")),
    lambda d: f"WITH member AS ({_MEMBERS}), e AS (SELECT x.community AS cs, y.community AS cd, weight FROM kg_edges k JOIN member x ON x.node = k.src JOIN member y ON y.node = k.dst), w AS (SELECT sum(weight) AS whole FROM e), deg AS (SELECT c, sum(weight) AS degree FROM (SELECT cs AS c, weight FROM e UNION ALL SELECT cd, weight FROM e) t GROUP BY c), i AS (SELECT cs AS c, sum(weight) AS inside FROM e WHERE cs = cd GROUP BY cs) SELECT round(sum(coalesce(inside, 0) / whole - power(degree / (2 * whole), 2)), 6) AS q FROM deg LEFT JOIN i ON i.c = deg.c, w",
)


def _ways(spark, sf, *, back: bool = False):
    """Edges as a, b, in their direction or against it."""
    e = view(spark, sf, "kg_edges")
    return e.select(F.col("dst").alias("a"), F.col("src").alias("b")) if back else e.select(F.col("src").alias("a"), F.col("dst").alias("b"))


#: All pairs that one, two or three edges join: the graph has no longer path that keeps its direction.
_PAIRS = "SELECT src AS start, dst AS uri, 1 AS hops FROM kg_edges UNION ALL SELECT a.src, b.dst, 2 FROM kg_edges a JOIN kg_edges b ON b.src = a.dst UNION ALL SELECT a.src, c.dst, 3 FROM kg_edges a JOIN kg_edges b ON b.src = a.dst JOIN kg_edges c ON c.src = b.dst"
frame("join_path_transitive", lambda spark, sf: closure(_ways(spark, sf)).select(F.col("a").alias("start"), F.col("b").alias("uri"), "hops"), lambda d: f"SELECT start, uri, min(hops) AS hops FROM ({_PAIRS}) x GROUP BY start, uri")
frame(
    "filter_entity_transitive", lambda spark, sf: closure(_ways(spark, sf, back=True), starts=spark.createDataFrame([("region/1",)], "a string"), least=0).select(F.col("b").alias("uri")),
    lambda d: f"SELECT 'region/1' AS uri UNION SELECT start FROM ({_PAIRS}) x WHERE uri = 'region/1'",
)
frame(
    "wd_hierarchy",
    lambda spark, sf: closure(_ways(spark, sf)).selectExpr("a AS start", "b AS uri", "hops AS level").unionByName(_ways(spark, sf, back=True).distinct().selectExpr("a AS start", "b AS uri", "-1 AS level")),
    lambda d: f"SELECT start, uri, min(hops) AS level FROM ({_PAIRS}) x GROUP BY start, uri UNION ALL SELECT DISTINCT dst, src, -1 FROM kg_edges",
)
frame(
    "wd_instance_hierarchy",
    lambda spark, sf: view(spark, sf, "SELECT uri, label FROM kg_nodes WHERE type = 'Supplier'").join(closure(_ways(spark, sf, back=True), starts=spark.createDataFrame([("region/2",)], "a string"), least=0).select(F.col("b").alias("uri")), "uri", "left_semi"),
    lambda d: "SELECT n.uri, n.label FROM kg_nodes n JOIN kg_edges a ON a.src = n.uri AND a.type = 'basedIn' JOIN kg_edges b ON b.src = a.dst AND b.type = 'inRegion' WHERE n.type = 'Supplier' AND b.dst = 'region/2'",
)
frame("graph_traverse", lambda spark, sf: graph.traverse(view(spark, sf, "kg_edges"), ["region/2"], depth=2), lambda d: "WITH RECURSIVE walk(node, hops) AS (SELECT 'region/2', 0 UNION SELECT e.b, w.hops + 1 FROM walk w JOIN (SELECT src AS a, dst AS b FROM kg_edges UNION SELECT dst, src FROM kg_edges) e ON e.a = w.node WHERE w.hops < 2) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node")
both("graph_induced_edges", lambda d: "SELECT e.src, e.dst, e.type FROM kg_edges e WHERE e.src IN (SELECT uri FROM kg_nodes WHERE score > 0.5) AND e.dst IN (SELECT uri FROM kg_nodes WHERE score > 0.5)")
both("graph_neighbors", lambda d: "SELECT 'out' AS direction, dst AS node, type, weight FROM kg_edges WHERE src = 'nation/4' UNION ALL SELECT 'in', src, type, weight FROM kg_edges WHERE dst = 'nation/4'")
both("graph_explore", lambda d: "SELECT s, p, o FROM kg_triples WHERE s = 'supplier/2' UNION SELECT t.s, t.p, t.o FROM kg_triples x JOIN kg_triples t ON t.s = x.o WHERE x.s = 'supplier/2'")
frame("graph_degree_centrality", lambda spark, sf: graph.degree_centrality(view(spark, sf, "kg_edges")).select("node", F.round("centrality", 6).alias("centrality")), lambda d: "SELECT a AS node, round(CAST(count(*) AS DOUBLE) / (max(n) - 1), 6) AS centrality FROM (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM kg_edges UNION ALL SELECT dst, src FROM kg_edges) u) e, (SELECT count(DISTINCT a) AS n FROM (SELECT src AS a FROM kg_edges UNION ALL SELECT dst FROM kg_edges) v) c GROUP BY a")
_co = "SELECT a.concept AS src, b.concept AS dst, CAST(count(*) AS DOUBLE) AS weight FROM concepts a JOIN concepts b ON a.item = b.item AND a.concept < b.concept GROUP BY a.concept, b.concept"
_strong = f"SELECT src, dst, weight FROM ({_co}) c, (SELECT avg(weight) AS mean FROM ({_co}) x) m WHERE weight > mean"
frame("graph_clustering_coeff", lambda spark, sf: graph.clustering(view(spark, sf, _strong)).select("node", F.round("coefficient", 6).alias("coefficient")), lambda d: f"WITH e AS ({_strong}), adj AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), deg AS (SELECT a, count(*) AS k FROM adj GROUP BY a HAVING count(*) > 1), tri AS (SELECT x.a, count(*) AS t FROM adj x JOIN adj y ON y.a = x.a AND x.b < y.b JOIN adj z ON z.a = x.b AND z.b = y.b GROUP BY x.a) SELECT deg.a AS node, round(2.0 * coalesce(t, 0) / (k * (k - 1)), 6) AS coefficient FROM deg LEFT JOIN tri ON tri.a = deg.a")
both("graph_cooccurrence_build", lambda d: _co)
frame("graph_weight_communities", lambda spark, sf: graph.components(view(spark, sf, _strong)).groupBy("component").count().where("count > 1").select("component", F.col("count").alias("n")), lambda d: f"WITH RECURSIVE e AS ({_strong}), reach(a, b) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, x.b FROM reach r JOIN (SELECT src AS s, dst AS b FROM e UNION SELECT dst, src FROM e) x ON x.s = r.b) SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) c GROUP BY component HAVING count(*) > 1")
both("graph_bridge_nodes", lambda d: "SELECT a AS node, count(DISTINCT n.type) AS types FROM kg_adj JOIN kg_nodes n ON n.uri = kg_adj.b GROUP BY a HAVING count(DISTINCT n.type) > 1")
both("graph_health", lambda d: "SELECT round(embedded / nodes, 6) AS coverage, round(edges / nodes, 6) AS connectivity, embedded / nodes >= 0.5 AND edges / nodes >= 0.1 AS healthy FROM (SELECT CAST(count(*) AS DOUBLE) AS nodes FROM kg_nodes) a, (SELECT CAST(count(*) AS DOUBLE) AS edges FROM kg_edges) b, (SELECT CAST(count(*) AS DOUBLE) AS embedded FROM embeddings) c")
both("graph_tilt_projection", lambda d: "SELECT n.uri, n.type, coalesce(g.degree, 0) AS degree, CASE WHEN coalesce(g.degree, 0) > 20 THEN 'hub' WHEN coalesce(g.degree, 0) > 1 THEN 'node' ELSE 'leaf' END AS hint FROM kg_nodes n LEFT JOIN (SELECT a, count(*) AS degree FROM kg_adj GROUP BY a) g ON g.a = n.uri WHERE n.type IN ('Nation', 'Region', 'Supplier')")
both("analysis_topk", lambda d: "SELECT metric, node, round(v, 6) AS v FROM (SELECT metric, node, v, row_number() OVER (PARTITION BY metric ORDER BY v DESC, node) AS r FROM (SELECT 'degree' AS metric, a AS node, CAST(count(*) AS DOUBLE) AS v FROM kg_adj GROUP BY a UNION ALL SELECT 'score', uri, score FROM kg_nodes UNION ALL SELECT 'weight', dst, sum(weight) FROM kg_edges GROUP BY dst) m) t WHERE r <= 10")
frame(
    "graph_full_analysis",
    lambda spark, sf: graph.analysis(view(spark, sf, "kg_edges")).select("node", F.round("centrality", 6).alias("centrality"), "core", "component"),
    lambda d: f"WITH {', '.join(_core_ctes('kg_edges', CORE_ROUNDS))}, l AS ({_labels_sql('kg_edges', LABEL_ROUNDS, 'SELECT node, label FROM LAST')}) SELECT c0.node, round(c0.core / (m.n - 1e0), 6) AS centrality, c.core, l.label AS component FROM c0 JOIN c{CORE_ROUNDS} c ON c.node = c0.node JOIN l ON l.node = c0.node, (SELECT count(*) AS n FROM c0) m",
)

GRID = som.Grid(6, 6)


def _trained(spark, sf):
    return som.train(view(spark, sf, "vectors"), GRID, epochs=5)


frame("som_train", lambda spark, sf: spark.createDataFrame([(i, float(e)) for i, e in enumerate(_trained(spark, sf)[1])], "epoch int, error double"))
frame("som_bmu", lambda spark, sf: som.assign(view(spark, sf, "vectors"), _trained(spark, sf)[0]))
frame("som_quality", lambda spark, sf: som.quality(som.assign(view(spark, sf, "vectors"), _trained(spark, sf)[0]), GRID))


def _topology(spark, sf):
    """Cells that vectors fall in, their neighbours on the grid, and the vectors of both."""
    hits = som.assign(view(spark, sf, "vectors"), _trained(spark, sf)[0]).groupBy("cell").agg(F.count("*").alias("n"))
    beside = F.broadcast(spark.createDataFrame(GRID.neighbours(), "cell int, neighbour int"))
    return hits.join(beside, "cell").join(hits.select(F.col("cell").alias("neighbour"), F.col("n").alias("n_neighbour")), "neighbour", "left").select("cell", "neighbour", "n", F.coalesce("n_neighbour", F.lit(0)).alias("n_neighbour"))


frame("som_topology", _topology)
frame("som_clusters", lambda spark, sf: spark.createDataFrame([(k, c) for k, g in enumerate(som.clusters(_trained(spark, sf)[0], GRID, similarity=0.2)) for c in g], "cluster int, cell int"))
frame("som_cluster_stats", lambda spark, sf: spark.createDataFrame([(k, c) for k, g in enumerate(som.clusters(_trained(spark, sf)[0], GRID, similarity=0.2)) for c in g], "cluster int, cell int").groupBy("cluster").count().agg(F.count("*").alias("n"), F.avg("count").alias("mean"), F.max("count").alias("largest"), F.min("count").alias("smallest")))
frame("som_feature_stats", lambda spark, sf: spark.createDataFrame([(i, float(v)) for i, v in enumerate(som.u_matrix(_trained(spark, sf)[0], GRID))], "cell int, distance double"))


def _targeted(spark, sf):
    """Chosen metrics of chosen nodes, a row for each: degree centrality and component of the suppliers."""
    edges = view(spark, sf, "kg_edges")
    degree = graph.degree_centrality(edges).where("node like 'supplier/%'").select("node", F.lit("degree").alias("metric"), F.round("centrality", 6).alias("value"), F.lit(None).cast("string").alias("label"))
    return degree.unionByName(graph.components(edges).where("node like 'supplier/%'").select("node", F.lit("component").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("component").alias("label")))


frame(
    "graph_targeted_analysis", _targeted,
    lambda d: _labels_sql(
        "kg_edges", LABEL_ROUNDS,
        "SELECT node, 'component' AS metric, CAST(NULL AS DOUBLE) AS value, label FROM LAST WHERE node LIKE 'supplier/%' UNION ALL SELECT a, 'degree', round(CAST(count(*) AS DOUBLE) / (max(n) - 1), 6), NULL FROM two, (SELECT count(DISTINCT a) AS n FROM two) c WHERE a LIKE 'supplier/%' GROUP BY a",
    ),
)
