"""Scans, filters, joins, aggregations, windows, sorts, sets and maintenance over the derived graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.overlap import expanded, overlapping
from .kg import DAY0, NOW
from .registry import both, frame, view

_DOMAIN_TYPE = "split_part(x, ':', 1)"


def _shared_properties(spark, sf):
    """Suppliers that have two properties or more in common, with the same value."""
    members = view(spark, sf, "SELECT s AS id, concat(p, '=', o) AS m FROM kg_triples WHERE s LIKE 'supplier/%' AND p <> 'suppliedBy'")
    names = F.array_sort(F.array_distinct(F.transform("shared", lambda m: F.substring_index(m, "=", 1))))
    slices = overlapping(members, 2).withColumn("names", names).where(F.size("names") >= 2)
    slices = slices.select("xs", "ys", "within", F.size("names").cast("long").alias("shared"), F.array_join("names", ",").alias("properties"))
    return expanded(slices).withColumnsRenamed({"a": "one", "b": "other"})


# Scans and typed reads.
both("scan_graph", lambda d: "SELECT s, p, o FROM kg_triples")
both("select_ask_generic", lambda d: "SELECT count(*) > 0 AS answer FROM kg_triples WHERE p = 'inRegion'")
both("load_history", lambda d: f"SELECT id, prompt, output, access_count, CASE WHEN ts >= {NOW} - INTERVAL 130 DAY THEN 'short-term' ELSE 'long-term' END AS memory_type FROM interactions UNION ALL SELECT uri, label, NULL, access_count, 'element' FROM elements WHERE access_count IS NOT NULL")
both("sparql_doc_source", lambda d: "SELECT uri, content AS text, source AS origin, label AS title FROM elements WHERE lang = 'en'")
both("bookmark_source", lambda d: "SELECT uri, created FROM elements e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id) ORDER BY created DESC, uri LIMIT 50")
both("store_lazy", lambda d: "SELECT uri, label, 'lazy' AS status FROM elements WHERE quality IS NULL")
both("process_lazy", lambda d: "SELECT uri, label, CASE WHEN quality IS NULL AND doc_id % 2 = 0 THEN 'processed' WHEN quality IS NULL THEN 'lazy' ELSE 'processed' END AS status FROM elements")

# Projections, filters, predicates.
both("bgp_type_scan", lambda d: "SELECT t.s AS uri, l.o AS label FROM kg_triples t JOIN kg_triples l ON t.s = l.s AND l.p = 'rdfs:label' WHERE t.p = 'rdf:type' AND t.o = 'Supplier'")
both("bind_if_case", lambda d: "SELECT uri, CASE WHEN type = 'Entity' THEN 0.1 WHEN type = 'Unit' THEN 0.08 WHEN type = 'TextElement' THEN 0.06 WHEN type = 'CommunityElement' THEN 0.04 WHEN type = 'Attribute' THEN 0.02 ELSE 0.0 END * 1e0 AS bonus FROM elements")
both("coalesce_default", lambda d: "SELECT uri, coalesce(modified, created) AS relevant_date, coalesce(quality, 0) AS quality, coalesce(access_count, 0) AS accesses FROM elements")
both("filter_contains_ci", lambda d: "SELECT uri FROM elements WHERE contains(lower(content), 'the') OR contains(lower(label), 'and')")
both("filter_regex_ci", lambda d: f"SELECT uri, label FROM kg_nodes WHERE {d.rx('lower(label)', 'asia|europe|supplier#0*1')}")
both("filter_in_list", lambda d: "SELECT uri, type, label FROM kg_nodes WHERE uri IN ('nation/1', 'nation/2', 'region/0', 'part/77', 'nobody/1')")
both("filter_strlen", lambda d: "SELECT uri, chars FROM elements WHERE chars > 1000")
both("filter_strstarts", lambda d: "SELECT uri FROM kg_nodes WHERE uri LIKE 'supplier/%' AND NOT (label LIKE '%1')")
both("filter_bound", lambda d: "SELECT uri, modified FROM elements WHERE modified IS NOT NULL AND (access_count IS NULL OR access_count > 30)")
both("filter_num_threshold", lambda d: "SELECT uri, freq, score FROM kg_nodes WHERE freq >= 10 AND score >= 0.4")
both("filter_temporal", lambda d: "SELECT uri, created FROM elements WHERE created >= TIMESTAMP '2024-02-01 00:00:00' AND created <= TIMESTAMP '2024-03-31 23:59:59'")
both("filter_temporal_keep_null", lambda d: "SELECT uri, modified FROM elements WHERE modified IS NULL OR modified BETWEEN TIMESTAMP '2024-02-01 00:00:00' AND TIMESTAMP '2024-03-01 00:00:00'")
both("filter_geo_bbox", lambda d: "SELECT uri, lat, lon FROM places WHERE lat BETWEEN -45 AND 45 AND lon BETWEEN -90 AND 120")
both("filter_geo_radius", lambda d: "SELECT uri, lat, lon FROM places WHERE abs(lat - 10) <= 4000.0 / 111 AND abs(lon - 20) <= 4000.0 / 111")
both("filter_geo_polygon", lambda d: "WITH polygon AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM places WHERE admin IN ('region/1', 'region/2')) SELECT uri FROM places, polygon WHERE lat BETWEEN a AND b AND lon BETWEEN c AND e")
both("filter_geo_admin", lambda d: "SELECT uri, label FROM places WHERE admin IN ('region/0', 'region/3')")
both("filter_topic_exact", lambda d: "SELECT uri FROM elements WHERE contains(lower(content), 'tion') ")
both("filter_topic_fuzzy", lambda d: f"SELECT uri FROM elements WHERE {d.rx('lower(content)', '[^a-z](ands?|thes?|cit(y|ies))[^a-z]')}")
both("filter_topic_semantic", lambda d: "WITH synonyms AS (SELECT 'and' AS term UNION ALL SELECT 'with' UNION ALL SELECT 'from') SELECT DISTINCT uri FROM elements, synonyms WHERE contains(lower(content), concat(' ', term, ' '))")
both("filter_topic_hierarchical", lambda d: "SELECT e.uri, e.type FROM elements e JOIN (SELECT 'Entity' AS type UNION ALL SELECT 'Unit') h ON e.type = h.type")
both("filter_entity_direct", lambda d: "SELECT doc_id, entity FROM mentions WHERE entity IN ('nation/3', 'nation/4', 'supplier/8')")
both("filter_entity_related", lambda d: "SELECT DISTINCT uri FROM (SELECT dst AS uri FROM kg_edges WHERE src = 'nation/3' UNION ALL SELECT src FROM kg_edges WHERE dst = 'nation/3') n")
both("filter_entity_typed", lambda d: "SELECT m.doc_id, m.entity FROM mentions m JOIN kg_nodes n ON m.entity = n.uri WHERE n.type IN ('Supplier')")
both("filter_concept_direct", lambda d: f"SELECT id FROM interactions WHERE {d.has('concepts', "'topic3'")} OR {d.has('concepts', "'lang1'")}")
both("filter_concept_categorical", lambda d: "SELECT DISTINCT c.item FROM concepts c JOIN (SELECT DISTINCT p_brand FROM part WHERE p_size > 45) p ON c.concept = p.p_brand")
both("filter_concept_relational", lambda d: "SELECT DISTINCT a.item FROM concepts a JOIN concepts b ON a.item = b.item AND a.concept = 'Brand#11' AND b.concept <> a.concept")
_concept_sim = lambda d: f"CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE CAST({d.size(d.intersect(d.rx_split('a', ' '), d.rx_split('b', ' ')))} AS DOUBLE) / {d.size(d.union(d.rx_split('a', ' '), d.rx_split('b', ' ')))} END * 1e0"
both("concept_label_similarity", lambda d: f"SELECT a, b, round({_concept_sim(d)}, 6) AS similarity FROM (SELECT DISTINCT lower(x.p_type) AS a, lower(y.p_type) AS b FROM (SELECT DISTINCT p_type FROM part) x CROSS JOIN (SELECT DISTINCT p_type FROM part) y) t")
both("filter_concept_similarity", lambda d: f"SELECT a, b FROM (SELECT DISTINCT lower(x.p_type) AS a, lower(y.p_type) AS b FROM (SELECT DISTINCT p_type FROM part) x CROSS JOIN (SELECT DISTINCT p_type FROM part) y) t WHERE {_concept_sim(d)} >= 0.5")
both("filter_temporal_range_grace", lambda d: "SELECT uri FROM elements WHERE created >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1 DAY AND created <= TIMESTAMP '2024-02-10 00:00:00' + INTERVAL 1 DAY")
both("filter_temporal_relative", lambda d: f"SELECT uri, created FROM elements WHERE created >= {NOW} - INTERVAL 90 DAY")
both("filter_temporal_periodic", lambda d: f"WITH days AS (SELECT {d.plus_days(DAY0, 'k * 7')} AS day FROM (SELECT 1 AS one) o{d.explode(d.sequence('0', '20'), 'k')}) SELECT e.uri, days.day FROM elements e JOIN days ON CAST(e.created AS DATE) = days.day")
both("filter_mem_relevance", lambda d: "SELECT id, importance FROM memories WHERE importance >= 0.7")
both("filter_mem_domain_hierarchy", lambda d: "WITH parents AS (SELECT 'project:1' AS child, 'user:0' AS parent UNION ALL SELECT 'project:2', 'user:0' UNION ALL SELECT 'session:0', 'project:1'), RANKED AS (SELECT child FROM parents WHERE parent = 'user:0' UNION SELECT p2.child FROM parents p1 JOIN parents p2 ON p2.parent = p1.child WHERE p1.parent = 'user:0' UNION SELECT 'user:0') " + f"SELECT DISTINCT m.id FROM memories m JOIN RANKED r ON {d.has('m.domains', 'r.child')}")
both("filter_mem_temporal_fading", lambda d: f"SELECT id FROM memories WHERE exp(-greatest({d.seconds(NOW)} - {d.seconds('last_accessed')}, 0) / 2592000.0) > 0.01")
both("filter_mem_cross_domain", lambda d: f"SELECT id, CAST(1.2 AS DOUBLE) AS boost FROM memories WHERE {d.size(d.distinct(d.map('domains', 'x', _DOMAIN_TYPE)))} > 1")
both("filter_nav_exclusion", lambda d: "SELECT n.uri FROM kg_nodes n WHERE n.type = 'Nation' AND NOT EXISTS (SELECT 1 FROM nav_views v WHERE v.corpuscle = n.uri AND v.tilt = 'error' AND v.view % 7 = 0 AND v.score > 90)")
both("filter_concept_any", lambda d: "SELECT DISTINCT item FROM concepts WHERE concept IN ('Brand#11', 'Brand#22', 'Brand#33')")
both("filter_concept_all", lambda d: "SELECT item FROM concepts WHERE concept IN ('Brand#11', 'Brand#22') GROUP BY item HAVING count(DISTINCT concept) = 2")
both("filter_system_rows", lambda d: "SELECT id FROM interactions WHERE NOT contains(prompt, 'System:') AND NOT contains(prompt, 'ZPT State Change:')")
both("facet_filter", lambda d: "SELECT type, lang, CAST(count(*) AS BIGINT) AS n FROM elements GROUP BY GROUPING SETS ((type), (lang), ())")
both("suggest_prefix", lambda d: "SELECT label, CAST(count(*) AS BIGINT) AS n FROM kg_nodes WHERE lower(label) LIKE 'customer#00000000%' GROUP BY label ORDER BY n DESC, label LIMIT 10")
both("project_zoom_fields", lambda d: "SELECT uri, label, type, freq FROM kg_nodes WHERE type <> 'Part'")
both("construct_triples", lambda d: "SELECT DISTINCT uri AS s, 'rdf:type' AS p, concat('quill:', type) AS o FROM kg_nodes UNION ALL SELECT DISTINCT uri, 'skos:prefLabel', label FROM kg_nodes UNION ALL SELECT DISTINCT concat(src, '>', dst), 'quill:weight', CAST(CAST(round(weight) AS BIGINT) AS STRING) FROM kg_edges".replace("STRING", "STRING" if d.name == "spark" else "VARCHAR"))
both("describe_entity", lambda d: "SELECT 'property' AS kind, p AS name, o AS value FROM kg_triples WHERE s = 'nation/7' UNION ALL SELECT 'incoming', p, s FROM kg_triples WHERE o = 'nation/7' UNION ALL SELECT 'unit', 'mentionedIn', concat('doc/', doc_id) FROM mentions WHERE entity = 'nation/7'")
both("parse_result_type", lambda d: "SELECT uri, CASE WHEN contains(lower(type), 'entity') OR type IN ('Nation', 'Region') THEN 'entity' WHEN contains(lower(type), 'unit') THEN 'unit' WHEN contains(lower(type), 'text') THEN 'text' WHEN contains(lower(type), 'community') THEN 'community' ELSE 'unknown' END AS zoom FROM (SELECT uri, type FROM elements UNION ALL SELECT uri, type FROM kg_nodes) u")

# Joins.
both("join_bgp_inner", lambda d: "SELECT c.label AS customer, n.label AS nation, r.label AS region FROM kg_nodes c JOIN kg_edges a ON a.src = c.uri AND a.type = 'livesIn' JOIN kg_nodes n ON n.uri = a.dst JOIN kg_edges b ON b.src = n.uri AND b.type = 'inRegion' JOIN kg_nodes r ON r.uri = b.dst")
both("join_optional_left", lambda d: "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("join_optional_nested", lambda d: "SELECT n.uri, e.src AS supplier, s.label FROM kg_nodes n LEFT JOIN (kg_edges e JOIN kg_nodes s ON s.uri = e.src AND s.score > 0.5) ON e.dst = n.uri AND e.type = 'basedIn' WHERE n.type = 'Nation'")
both("join_anti_not_exists", lambda d: "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
both("join_minus", lambda d: "SELECT uri FROM kg_nodes n LEFT ANTI JOIN mentions e ON n.uri = e.entity WHERE n.type <> 'Part'" if d.name == "spark" else "SELECT uri FROM kg_nodes n ANTI JOIN mentions e ON n.uri = e.entity WHERE n.type <> 'Part'")
both("join_semi_exists", lambda d: "SELECT CAST(count(*) AS BIGINT) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
both("join_cross_graph", lambda d: "SELECT e.uri, e.label, i.item_id FROM elements e JOIN benchmark i ON e.doc_id = i.item_id")
both("join_self_neq", lambda d: "SELECT a.entity AS one, b.entity AS other, CAST(count(*) AS BIGINT) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity <> b.entity GROUP BY a.entity, b.entity")
both("join_same_source", lambda d: "SELECT a.uri, CAST(count(*) AS BIGINT) AS siblings FROM elements a JOIN elements b ON a.source = b.source AND a.uri <> b.uri AND a.lang = b.lang GROUP BY a.uri")
both("join_two_hop", lambda d: "SELECT DISTINCT a.src AS start, b.dst AS goal FROM kg_edges a JOIN kg_edges b ON a.dst = b.src WHERE a.src <> b.dst AND a.type = 'basedIn'")
both("join_theta_next", lambda d: "SELECT id, ts, min(ts) OVER (PARTITION BY conv_id ORDER BY ts RANGE BETWEEN INTERVAL '1' SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts FROM interactions")
both("join_path_alternation_inverse", lambda d: "SELECT a, CAST(count(*) AS BIGINT) AS degree FROM kg_adj GROUP BY a")
both("join_federated_service", lambda d: "SELECT e.src, e.dst, l.label AS dst_label FROM kg_edges e LEFT JOIN kg_nodes l ON l.uri = e.dst WHERE e.type IN ('inRegion', 'basedIn')")
both("join_values_inline", lambda d: "SELECT v.view, z.rank FROM nav_views v JOIN (SELECT 'entity' AS zoom, 1 AS rank UNION ALL SELECT 'unit', 2 UNION ALL SELECT 'text', 3 UNION ALL SELECT 'community', 4 UNION ALL SELECT 'corpus', 5) z ON v.zoom = z.zoom")
both("join_nested_loop_sim", lambda d: "SELECT a.concept AS one, b.concept AS other, round(CAST(count(*) AS DOUBLE) / (max(a.n) + max(b.n) - count(*)), 6) AS jaccard FROM (SELECT concept, item, count(*) OVER (PARTITION BY concept) AS n FROM concepts) a JOIN (SELECT concept, item, count(*) OVER (PARTITION BY concept) AS n FROM concepts) b ON a.item = b.item AND a.concept < b.concept GROUP BY a.concept, b.concept")
both("join_dictionary", lambda d: "SELECT r.uri, r.score, e.type, e.label FROM results r JOIN elements e ON r.uri = e.uri")
both("join_interval", lambda d: f"WITH periods AS (SELECT k, {d.plus_days(DAY0, 'k * 5')} AS a, {d.plus_days(DAY0, 'k * 5 + 2')} AS b FROM (SELECT 1 AS one) o{d.explode(d.sequence('0', '5'), 'k')}) SELECT p.k, CAST(count(*) AS BIGINT) AS n FROM events e JOIN periods p ON CAST(e.ts AS DATE) BETWEEN p.a AND p.b GROUP BY p.k")

# Aggregations.
both("agg_count_star", lambda d: "SELECT CAST(count(*) AS BIGINT) AS total_chunks FROM elements")
both("agg_multi_count_distinct", lambda d: "SELECT (SELECT count(DISTINCT uri) FROM kg_nodes) AS entities, (SELECT count(DISTINCT type) FROM kg_edges) AS relationship_types, (SELECT count(DISTINCT doc_id) FROM documents) AS units, (SELECT count(DISTINCT vec_id) FROM embeddings) AS embedded, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions")
both("agg_graph_stats", lambda d: "SELECT CAST(count(*) AS BIGINT) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects FROM kg_triples")
both("agg_class_histogram", lambda d: "SELECT o AS class, CAST(count(*) AS BIGINT) AS n FROM kg_triples WHERE p = 'rdf:type' GROUP BY o")
both("agg_predicate_histogram", lambda d: "SELECT p AS predicate, CAST(count(*) AS BIGINT) AS n FROM kg_triples GROUP BY p")
both("agg_graph_type_predicate_counts", lambda d: "SELECT t.o AS type, x.p AS predicate, CAST(count(*) AS BIGINT) AS n FROM kg_triples t JOIN kg_triples x ON t.s = x.s WHERE t.p = 'rdf:type' GROUP BY t.o, x.p")
both("agg_community", lambda d: "SELECT e.dst AS community, CAST(count(e.src) AS BIGINT) AS members, round(avg(n.score), 6) AS avg_score FROM kg_edges e JOIN kg_nodes n ON n.uri = e.src WHERE e.type IN ('livesIn', 'basedIn') GROUP BY e.dst")
both("agg_corpus", lambda d: "SELECT source AS corpus, count(DISTINCT type) AS types, count(DISTINCT uri) AS units, round(avg(CAST(chars AS DOUBLE)), 6) AS avg_chars, CAST(sum(coalesce(access_count, 0)) AS BIGINT) AS accesses FROM elements GROUP BY source")
both("agg_zoom_metrics", lambda d: "SELECT zoom, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS avg_score, max(score) AS max_score, round(sum(score), 4) AS sum_score, count(DISTINCT session) AS sessions FROM nav_views GROUP BY zoom")
both("agg_group_concat_having", lambda d: f"SELECT lower(p_type) AS concept, CAST(count(*) AS BIGINT) AS n, {d.words_joined('p_brand', '|')} AS brands, max(p_size) AS largest FROM part GROUP BY lower(p_type) HAVING count(*) > 1")
both("agg_relationship_count_avg", lambda d: "SELECT entity, CAST(count(*) AS BIGINT) AS relationships, round(avg(weight), 6) AS avg_weight FROM (SELECT src AS entity, weight FROM kg_edges UNION ALL SELECT dst, weight FROM kg_edges) r GROUP BY entity")
both("agg_cooccurrence", lambda d: "WITH pairs AS (SELECT a.concept AS one, b.concept AS other, CAST(count(*) AS BIGINT) AS n FROM concepts a JOIN concepts b ON a.item = b.item AND a.concept < b.concept GROUP BY a.concept, b.concept), top AS (SELECT max(n) AS most FROM pairs) SELECT one, other, n, round(CAST(n AS DOUBLE) / most, 6) AS strength FROM pairs, top WHERE CAST(n AS DOUBLE) / most >= 0.3")
both("agg_shared_interactions", lambda d: "SELECT one, other, shared, CASE WHEN shared >= 12 THEN 0.8 WHEN shared >= 8 THEN 0.5 ELSE 0.2 END * 1e0 AS strength FROM (SELECT a.concept AS one, b.concept AS other, count(DISTINCT a.item) AS shared FROM concepts a JOIN concepts b ON a.item = b.item AND a.concept <> b.concept GROUP BY a.concept, b.concept) s")
both("agg_having_degree", lambda d: "SELECT dst AS source, CAST(count(*) AS BIGINT) AS links FROM kg_edges GROUP BY dst HAVING count(*) > 50")
both("agg_nav_analytics", lambda d: "SELECT zoom, tilt, CAST(count(*) AS BIGINT) AS sessions, round(avg(CAST(corpuscles AS DOUBLE)), 6) AS avg_corpuscles, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM (SELECT session, zoom, tilt, count(DISTINCT corpuscle) AS corpuscles, min(ts) AS first_ts, max(ts) AS last_ts FROM nav_views GROUP BY session, zoom, tilt) v GROUP BY zoom, tilt")
both("agg_nav_views", lambda d: f"SELECT session, {d.words_joined('pan', ',')} AS pans, count(DISTINCT corpuscle) AS corpuscles, {d.words_joined('zoom', ',')} AS zooms FROM nav_views GROUP BY session")
both("agg_cross_zoom", lambda d: "SELECT corpuscle, count(DISTINCT zoom) AS zooms FROM nav_views GROUP BY corpuscle HAVING count(DISTINCT zoom) > 1")
both("agg_session_summary", lambda d: f"SELECT session, min(ts) AS started, max(ts) AS ended, max({d.seconds('ts')}) - min({d.seconds('ts')}) AS duration, CAST(count(*) AS BIGINT) AS views FROM nav_views GROUP BY session")
both("agg_tilt_effectiveness", lambda d: "SELECT tilt, round(avg(score), 6) AS effectiveness, CAST(count(*) AS BIGINT) AS n FROM nav_views GROUP BY tilt")
both("agg_chunk_count_per_doc", lambda d: "SELECT conv_id AS document, count(DISTINCT turn) AS chunks FROM conversations GROUP BY conv_id")
both("agg_vsom_relations", lambda d: "SELECT n.uri, CAST(count(e.a) AS BIGINT) AS relations FROM kg_nodes n LEFT JOIN kg_adj e ON e.a = n.uri WHERE n.type IN ('Nation', 'Supplier') GROUP BY n.uri")
frame("agg_shared_properties", _shared_properties, lambda d: f"SELECT a.s AS one, b.s AS other, count(DISTINCT a.p) AS shared, {d.words_joined('a.p', ',')} AS properties FROM kg_triples a JOIN kg_triples b ON a.p = b.p AND a.o = b.o AND a.s < b.s WHERE a.s LIKE 'supplier/%' AND b.s LIKE 'supplier/%' AND a.p <> 'suppliedBy' GROUP BY a.s, b.s HAVING count(DISTINCT a.p) >= 2")
both("agg_chunk_stats", lambda d: "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS total, round(avg(CAST(chars AS DOUBLE)), 6) AS mean, min(chars) AS least, max(chars) AS most, round(var_pop(CAST(chars AS DOUBLE)), 3) AS variance FROM elements GROUP BY source")
both("agg_cohesion_size", lambda d: "SELECT source, CASE WHEN count(*) <= 1 THEN 1.0 ELSE round(greatest(0.0, 1 - stddev_pop(CAST(chars AS DOUBLE)) / avg(CAST(chars AS DOUBLE))), 2) END * 1e0 AS cohesion FROM elements GROUP BY source")
both("agg_centroid", lambda d: f"SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM vectors{d.posexplode('v', 'pos', 'x')} GROUP BY label, pos")
both("agg_embedding_dims", lambda d: f"SELECT {d.size('v')} AS dims, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN {d.size('v')} <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM vectors GROUP BY {d.size('v')}")
both("agg_keyword_global", lambda d: f"SELECT w AS keyword, CAST(max(n) AS BIGINT) AS best, CAST(sum(n) AS BIGINT) AS freq, CAST(count(*) AS BIGINT) AS sources FROM (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, w FROM benchmark{d.explode(d.rx_split('lower(text)', '[^a-z]+'), 'w')}) t WHERE length(w) > 4 GROUP BY item_id, w) k GROUP BY w")
both("agg_confidence_dist", lambda d: "SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, min(score) AS least, max(score) AS most, CAST(count(*) AS BIGINT) AS n FROM kg_nodes WHERE score > 0")
both("agg_temporal_bucket", lambda d: f"SELECT {d.date_text('ts', 'yyyy-MM-dd', '%Y-%m-%d')} AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, {d.words_joined('event_type', ',')} AS types FROM events GROUP BY {d.date_text('ts', 'yyyy-MM-dd', '%Y-%m-%d')}")
both("agg_running_average", lambda d: "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 6) AS running, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END * 1e0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 6) AS success FROM events")
both("agg_grouping_sets_cube_rollup", lambda d: "SELECT zoom, tilt, CAST(count(*) AS BIGINT) AS n FROM nav_views GROUP BY CUBE (zoom, tilt)")

# Windows, ranking, sequences.
both("win_rank_results", lambda d: "SELECT uri, origin, score, row_number() OVER (PARTITION BY origin ORDER BY score DESC, uri) AS rank FROM results")
both("win_topk_per_type", lambda d: "SELECT * FROM (SELECT type, uri, score, row_number() OVER (PARTITION BY type ORDER BY score DESC, uri) AS rank FROM kg_nodes) t WHERE rank <= 5")
both("win_prev_next_chunk", lambda d: "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following, row_number() OVER w AS sequence, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
both("win_next_view_duration", lambda d: f"SELECT view, session, {d.seconds('lead(ts) OVER (PARTITION BY session ORDER BY ts, view)')} - {d.seconds('ts')} AS seconds FROM nav_views")
both("win_overlap_prefix", lambda d: "SELECT conv_id, turn, concat(coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 50), ''), text) AS content FROM conversations")
_gaps = lambda d: f"SELECT user_id, event_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT user_id, event_id, ts, CASE WHEN {d.seconds('ts')} - {d.seconds('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} <= LIMIT_ THEN 0 ELSE 1 END AS gap FROM events) g"
both("win_gap_sequences", lambda d: f"SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, min(ts) AS started, max(ts) AS ended, max({d.seconds('ts')}) - min({d.seconds('ts')}) AS seconds FROM ({_gaps(d).replace('LIMIT_', '86400')}) i GROUP BY user_id, island HAVING count(*) > 1")
both("win_bursts", lambda d: f"SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, min(ts) AS started FROM ({_gaps(d).replace('LIMIT_', '3600')}) i GROUP BY user_id, island HAVING count(*) >= 3")
both("win_periodicity", lambda d: f"SELECT user_id, round(avg(gap), 3) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS ratio, stddev_pop(gap) / avg(gap) < 0.2 AS periodic FROM (SELECT user_id, CAST({d.seconds('CAST(day AS TIMESTAMP)')} - {d.seconds('CAST(lag(day) OVER (PARTITION BY user_id ORDER BY day) AS TIMESTAMP)')} AS DOUBLE) AS gap FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) e) g WHERE gap IS NOT NULL GROUP BY user_id HAVING count(*) >= 2")
both("win_recent_n", lambda d: "SELECT id, ts FROM interactions ORDER BY ts DESC, id LIMIT 3")
both("win_history_window", lambda d: "SELECT view, round(avg(CASE WHEN score > 50 THEN 1.0 ELSE 0.0 END * 1e0) OVER (PARTITION BY tilt, zoom ORDER BY ts, view ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS success_rate FROM nav_views")
both("win_convergence", lambda d: f"SELECT event_id, coalesce({d.deviation_over('value', 'PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')} < 20, false) AS converged FROM events")
both("win_context_prune", lambda d: f"SELECT id, importance FROM memories WHERE importance >= 0.5 AND {d.seconds(NOW)} - {d.seconds('last_accessed')} < 12000000 ORDER BY importance DESC, id LIMIT 20")
both("win_keep_last_dedup", lambda d: "SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) t WHERE r = 1")

# Sorts, limits, sets.
both("topk_generic", lambda d: "SELECT uri, score FROM kg_nodes ORDER BY score DESC, uri LIMIT 10")
both("order_multi", lambda d: "SELECT uri, type, access_count FROM elements ORDER BY access_count DESC NULLS LAST, type ASC, uri LIMIT 100")
both("limit_offset", lambda d: "SELECT uri FROM kg_nodes ORDER BY uri LIMIT 50 OFFSET 100")
both("topk_candidates_cap", lambda d: "SELECT uri, score FROM results ORDER BY score DESC, uri, origin LIMIT 20")
both("sort_result_merge", lambda d: "SELECT key, max(score) AS score, CAST(count(*) AS BIGINT) AS passes FROM (SELECT substring(content, 1, 50) AS key, score FROM results) r GROUP BY key")
both("set_union_branches", lambda d: "SELECT 'entity' AS branch, uri FROM kg_nodes WHERE type = 'Nation' UNION ALL SELECT 'unit', uri FROM elements WHERE type = 'Unit' UNION ALL SELECT 'interaction', id FROM interactions UNION ALL SELECT 'place', uri FROM places")
both("set_distinct", lambda d: "SELECT DISTINCT type, lang, source FROM elements")
both("set_dedup_uri", lambda d: "SELECT uri, origin, score FROM (SELECT uri, origin, score, row_number() OVER (PARTITION BY uri ORDER BY score DESC, origin) AS r FROM results) t WHERE r = 1")
both("set_intersect_minus", lambda d: f"SELECT id, {d.size(d.intersect('domains', d.array("'project:1'", "'user:0'")))} AS common, {d.size(d.union('domains', d.array("'project:1'", "'user:0'")))} AS every FROM memories")
both("set_minus_stage", lambda d: "SELECT e.uri FROM elements e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id AND l.quality = 1)")
both("set_concept_merge", lambda d: "SELECT a.concept, b.concept IS NOT NULL AS known FROM (SELECT DISTINCT lower(p_type) AS concept FROM part) a LEFT JOIN (SELECT DISTINCT lower(p_type) AS concept FROM part JOIN lineitem ON l_partkey = p_partkey) b ON a.concept = b.concept")

# External-knowledge shapes, over the derived graph.
both("wd_concept_discovery", lambda d: "SELECT uri, max(match) AS match FROM (SELECT uri, 3 AS match FROM kg_nodes WHERE lower(label) LIKE '%nation_1%' UNION ALL SELECT e.src, 2 FROM kg_edges e JOIN kg_nodes n ON e.dst = n.uri WHERE lower(n.label) LIKE '%asia%' UNION ALL SELECT uri, 1 FROM kg_nodes WHERE lower(type) LIKE '%reg%') m GROUP BY uri")
both("wd_entity_properties", lambda d: "SELECT t.p AS property, t.o AS value, CASE WHEN n.uri IS NULL THEN 'literal' ELSE 'uri' END AS value_type, n.label AS value_label FROM kg_triples t LEFT JOIN kg_nodes n ON n.uri = t.o WHERE t.s = 'supplier/3'")
both("wd_entity_relationships", lambda d: "SELECT 'outgoing' AS direction, type, dst AS related FROM kg_edges WHERE src = 'supplier/3' UNION ALL SELECT 'incoming', type, src FROM kg_edges WHERE dst = 'supplier/3'")
both("wd_entity_search", lambda d: "SELECT uri, label, CASE WHEN lower(label) = 'asia' THEN 1.0 WHEN lower(label) LIKE 'a%' THEN 0.7 ELSE 0.4 END * 1e0 AS score FROM kg_nodes WHERE type IN ('Nation', 'Region') AND contains(lower(label), 'i')")
both("wd_geospatial", lambda d: "SELECT uri AS entity, lat, lon, 'own' AS location_type FROM places UNION ALL SELECT e.src, p.lat, p.lon, 'container' FROM kg_edges e JOIN places p ON e.dst = p.uri WHERE e.type = 'basedIn' UNION ALL SELECT p.admin, p.lat, p.lon, 'contained' FROM places p")
both("wd_semantic_similarity", lambda d: "SELECT b.s AS similar, count(DISTINCT a.p) AS shared FROM kg_triples a JOIN kg_triples b ON a.p = b.p AND a.o = b.o AND a.s <> b.s WHERE a.s = 'supplier/3' AND b.s LIKE 'supplier/%' GROUP BY b.s")
both("wd_temporal", lambda d: "SELECT uri AS entity, 'created' AS property, created AS at FROM elements UNION ALL SELECT uri, 'modified', modified FROM elements WHERE modified IS NOT NULL")
both("wd_wikipedia_mapping", lambda d: "SELECT uri, label, concat('wiki/', replace(label, ' ', '_')) AS title FROM kg_nodes WHERE contains(label, '_2')")
both("wd_entity_details", lambda d: "SELECT v.uri, n.label, n.type FROM (SELECT 'nation/1' AS uri UNION ALL SELECT 'region/2' UNION ALL SELECT 'ghost/1') v LEFT JOIN kg_nodes n ON n.uri = v.uri")

# Remaining analytics.
both("agg_endpoint_stats", lambda d: "SELECT (SELECT count(*) FROM kg_triples) AS triples, (SELECT count(*) FROM kg_nodes WHERE type LIKE 'S%') AS entities, (SELECT count(*) FROM kg_edges) AS relationships, (SELECT count(DISTINCT session) FROM nav_views) AS sessions, (SELECT count(*) FROM nav_views) AS views, (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM memories) AS memory_items")
both("agg_recent_activity", lambda d: "SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(ts) AS latest FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY event_type")
both("agg_nav_stats", lambda d: f"SELECT count(DISTINCT session) AS sessions, count(DISTINCT view) AS views, round(avg(CAST({d.length('corpuscle')} AS DOUBLE)), 6) AS avg_query_length FROM nav_views")
both("agg_zoom_distribution", lambda d: "SELECT zoom, CAST(count(*) AS BIGINT) AS n FROM nav_views GROUP BY zoom")
both("agg_predicate_subject_counts", lambda d: "SELECT p AS predicate, CAST(count(*) AS BIGINT) AS n, count(DISTINCT s) AS subjects FROM kg_triples GROUP BY p")
both("agg_blank_connections", lambda d: "SELECT o AS connected_to, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN s LIKE 'part/%9' THEN concat('_:', s) ELSE s END AS s, p, o FROM kg_triples) t WHERE s LIKE '_:%' AND p <> 'rdfs:label' GROUP BY o")
both("agg_api_graph_stats", lambda d: "SELECT (SELECT count(DISTINCT uri) FROM kg_nodes) AS entities, (SELECT count(*) FROM kg_edges) AS relationships, (SELECT count(DISTINCT uri) FROM elements WHERE type = 'Unit') AS units, (SELECT count(DISTINCT uri) FROM elements WHERE type = 'Attribute') AS attributes")
both("scan_docqa", lambda d: f"SELECT b.item_id, {d.length('b.text')} AS chars, {d.collected('m.entity')} AS concepts FROM benchmark b JOIN mentions m ON m.doc_id = b.item_id GROUP BY b.item_id, {d.length('b.text')}")
both("search_orchestrator_fuse", lambda d: "SELECT uri, origin, weight FROM (SELECT uri, origin, score * CASE origin WHEN 'exact' THEN 1.0 WHEN 'vector' THEN 0.6 ELSE 0.4 END AS weight, row_number() OVER (PARTITION BY uri ORDER BY score * CASE origin WHEN 'exact' THEN 1.0 WHEN 'vector' THEN 0.6 ELSE 0.4 END DESC, origin) AS r FROM results) t WHERE r = 1")
both("search_strategy_tier", lambda d: f"SELECT id, CASE WHEN {d.size('concepts')} <= 2 THEN 0.8 WHEN {d.size('concepts')} <= 5 THEN 0.7 ELSE 0.6 END * 1e0 AS threshold, CASE WHEN {d.size('concepts')} <= 2 THEN 5 WHEN {d.size('concepts')} <= 5 THEN 10 ELSE 15 END AS n FROM interactions")
both("doc_list", lambda d: "SELECT source, CAST(count(*) AS BIGINT) AS documents, max(created) AS latest FROM elements GROUP BY source")
both("doc_chunks", lambda d: "SELECT conv_id, turn, role FROM conversations")
both("doc_delete", lambda d: "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id AND x.source = 'src1')")
both("kg_nodes_edges", lambda d: "SELECT 'node' AS kind, type, CAST(count(*) AS BIGINT) AS n FROM kg_nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM kg_edges GROUP BY type")
both("preview_counts", lambda d: "SELECT zoom, CAST(count(*) AS BIGINT) AS n, CAST(count(*) * CASE zoom WHEN 'micro' THEN 10 WHEN 'entity' THEN 50 WHEN 'unit' THEN 200 WHEN 'text' THEN 500 WHEN 'community' THEN 800 ELSE 2000 END AS BIGINT) AS tokens FROM nav_views GROUP BY zoom")
both("metrics_cache_hit_rate", lambda d: "SELECT user_id, round(CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS hit_rate FROM events GROUP BY user_id")
both("compose_context", lambda d: "SELECT id, 'session' AS origin FROM (SELECT id FROM interactions ORDER BY ts DESC, id LIMIT 5) s UNION ALL SELECT id, 'memory' FROM (SELECT id FROM interactions ORDER BY access_count DESC, id LIMIT 8) m")
both("augment_auto_plan", lambda d: f"SELECT uri, CASE WHEN chars > 4000 THEN 'chunk' WHEN {d.rx_count('content', '[.!?]')} > 10 THEN 'attributes' WHEN chars > 200 THEN 'concepts' ELSE 'embed' END AS operation FROM elements")
both("estimate_tokens_zoom", lambda d: "SELECT DISTINCT zoom, CASE zoom WHEN 'micro' THEN 10 WHEN 'entity' THEN 50 WHEN 'unit' THEN 200 WHEN 'text' THEN 500 WHEN 'community' THEN 800 ELSE 2000 END AS tokens FROM nav_views")
