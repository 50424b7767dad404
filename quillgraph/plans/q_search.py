"""Search, scoring and fusion: each a whole plan over the derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..operators.vector_index import VectorIndex
from .kg import NOW
from .q_scalars import _Q, cosine
from .registry import both, frame, view

# Ranking weights of the flagship query.
SEMANTIC, STRUCTURAL, TEMPORAL, RELATIONAL = 0.4, 0.2, 0.2, 0.2

both("score_doc_relevance", lambda d: f"""
    WITH links AS (SELECT entity, doc_id, weight FROM mentions),
    structure AS (SELECT doc_id, count(DISTINCT entity) AS relationships, avg(CAST(weight AS DOUBLE)) AS avg_weight FROM links GROUP BY doc_id),
    authority AS (SELECT source, avg(CAST(coalesce(quality, 0) AS DOUBLE)) AS authority FROM elements GROUP BY source),
    scored AS (
      SELECT e.uri, e.type, e.label, coalesce(e.similarity, 0) AS semantic, coalesce(least(1.0, s.relationships / 10.0), 0) AS structural,
        greatest(0.0, 1 - ({d.seconds(NOW)} - {d.seconds('coalesce(e.modified, e.created)')}) / 31536000.0 / 5) AS temporal, coalesce(s.avg_weight, 0) / 10 AS relational,
        CASE e.type WHEN 'Entity' THEN 0.1 WHEN 'Unit' THEN 0.08 WHEN 'TextElement' THEN 0.06 WHEN 'CommunityElement' THEN 0.04 WHEN 'Attribute' THEN 0.02 ELSE 0.0 END AS type_bonus,
        least(0.2, e.chars / 5000.0) AS length_bonus, coalesce(least(0.1, e.access_count / 100.0), 0) AS usage_bonus, coalesce(a.authority, 0.5) * 0.1 AS authority_bonus, coalesce(CAST(e.quality AS DOUBLE), 0.5) AS quality
      FROM elements e LEFT JOIN structure s ON s.doc_id = e.doc_id LEFT JOIN authority a ON a.source = e.source
    )
    SELECT uri, type, label, round(CAST({SEMANTIC} * semantic + {STRUCTURAL} * structural + {TEMPORAL} * temporal + {RELATIONAL} * relational + type_bonus + length_bonus + usage_bonus + authority_bonus + 0.1 * quality AS DOUBLE), 6) AS final_score,
      round(CAST(structural AS DOUBLE), 6) AS structural, round(CAST(temporal AS DOUBLE), 6) AS temporal, round(CAST(relational AS DOUBLE), 6) AS relational FROM scored""")

_L2 = lambda d: f"sqrt({d.zip_sum('v', 'q', '(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))')})"
both("knn_flat_l2", lambda d: f"SELECT vec_id, round({_L2(d)}, 5) AS distance FROM vectors, {_Q} ORDER BY {_L2(d)}, vec_id LIMIT 10")
both("knn_index_maintain", lambda d: f"SELECT vec_id, label FROM vectors WHERE {d.size('v')} = 64 AND {d.size(d.keep('v', 'x', 'abs(x) > 1e-7'))} > 0")


def _index(spark, rows) -> VectorIndex:
    return VectorIndex.build(rows, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


def _index_search(spark, sf):
    """The exact search over the index, types filtered before the cut."""
    rows = view(spark, sf, "vectors")
    found = _index(spark, rows).search(rows.where("vec_id = 0"), 10, probes=None, types=[1, 2, 3])
    return rows.select("vec_id", "label").join(found.select(F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity")), "vec_id")


def _index_batch(spark, sf):
    """Every vector whose id 50 divides as a query against all others, through an index that got its last fifth later."""
    rows = view(spark, sf, "vectors")
    index = _index(spark, rows.where("label <> 3"))
    index.append(rows.where("label = 3"))
    return index.search(rows.where("vec_id % 50 = 0"), 10, probes=None).select("query", "id", F.round("similarity", 5).alias("similarity"))


frame("knn_hnsw_cosine", _index_search, lambda d: f"SELECT vec_id, label, round({cosine(d)}, 5) AS similarity FROM vectors, {_Q} WHERE label IN (1, 2, 3) ORDER BY {cosine(d)} DESC, vec_id LIMIT 10")
frame("knn_index_batch", _index_batch, lambda d: "SELECT query, id, round(s, 5) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS id, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS r FROM (SELECT x.vec_id, y.vec_id AS other, list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])) AS s FROM vectors x, vectors y WHERE x.vec_id % 50 = 0) a JOIN vectors b ON b.vec_id = a.other) t WHERE r <= 10")
both("knn_similar_nodes", lambda d: f"SELECT vec_id, round({cosine(d)}, 5) AS similarity FROM vectors, {_Q} WHERE vec_id <> 0 ORDER BY {cosine(d)} DESC, vec_id LIMIT 10")
both("win_topk_by_type_knn", lambda d: f"SELECT label, vec_id, round(s, 5) AS similarity FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM (SELECT label, vec_id, {cosine(d)} AS s FROM vectors, {_Q}) c) t WHERE r <= 3")
both("sim_threshold_search", lambda d: f"SELECT vec_id, label, round(s, 5) AS similarity FROM (SELECT vec_id, label, {cosine(d)} AS s FROM vectors, {_Q}) t WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10")
both("sim_session_cache", lambda d: f"SELECT vec_id, round(s, 5) AS similarity FROM (SELECT vec_id, {cosine(d)} AS s FROM vectors, {_Q}) t WHERE s >= 0.5")
both("sim_safe_search", lambda d: "SELECT uri, round(max(score / CASE WHEN most > 1 THEN most ELSE 1 END), 6) AS score FROM results, (SELECT max(score) AS most FROM results) m WHERE NOT contains(content, 'System:') GROUP BY uri")
both("search_dual", lambda d: f"WITH exact AS (SELECT uri, 1.0 * CASE WHEN lower(label) = 'nation_7' THEN 1.0 ELSE 0.8 END AS s FROM kg_nodes WHERE contains(lower(label), 'ion') AND type IN ('Nation', 'Region')), near AS (SELECT concat('nation/', vec_id % 25) AS uri, max({cosine(d)}) AS s FROM vectors, {_Q} GROUP BY concat('nation/', vec_id % 25)), linked AS (SELECT dst AS uri, 0.5 AS s FROM kg_edges WHERE type = 'inRegion' GROUP BY dst) SELECT uri, round(sum(CAST(s AS DOUBLE)), 5) AS score, {d.words_joined('src', ',')} AS sources FROM (SELECT uri, s * 1.0 AS s, 'exact' AS src FROM exact UNION ALL SELECT uri, s * 0.7, 'vector' FROM near UNION ALL SELECT uri, s * 0.5, 'graph' FROM linked) u GROUP BY uri")
both("search_query_confidence", lambda d: f"SELECT item_id, round(CAST(0.4 * least(n / 3.0, 1) + 0.3 + CASE WHEN n > 4 THEN 0.3 ELSE 0 END AS DOUBLE), 6) AS confidence FROM (SELECT item_id, {d.size(d.rx_all('text', '[A-Z][a-z]+'))} AS n FROM benchmark) t")
both("search_resolve_entities", lambda d: "SELECT q.name, min(n.uri) AS uri FROM (SELECT 'nation_7' AS name UNION ALL SELECT 'asia' UNION ALL SELECT 'nowhere') q LEFT JOIN kg_nodes n ON lower(n.label) = q.name GROUP BY q.name")
_weight = "CASE type WHEN 'Entity' THEN 1.0 WHEN 'Unit' THEN 0.9 WHEN 'TextElement' THEN 0.8 WHEN 'CommunityElement' THEN 0.7 WHEN 'Attribute' THEN 0.6 ELSE 0.5 END"
both("search_filter_pipeline", lambda d: f"WITH kept AS (SELECT uri, type, max(score) AS score FROM results WHERE score >= 0.3 AND type IN ('Entity', 'Unit', 'TextElement') GROUP BY uri, type), top AS (SELECT uri, type, score, score * {_weight} AS weighted FROM kept ORDER BY score * {_weight} DESC, uri LIMIT 50) SELECT uri, type, round(weighted, 6) AS weighted, round((score - a) / nullif(b - a, 0), 6) AS normal FROM top, (SELECT min(score) AS a, max(score) AS b FROM top) r")
both("rank_weighted", lambda d: f"SELECT uri, origin, round(score * {_weight}, 6) AS weighted FROM results ORDER BY score * {_weight} DESC, uri, origin LIMIT 50")
both("rank_score", lambda d: "SELECT uri, origin, round(score, 6) AS score FROM results ORDER BY score DESC, uri, origin LIMIT 50")
both("rank_type", lambda d: f"SELECT uri, origin, type FROM results ORDER BY {_weight} DESC, score DESC, uri, origin LIMIT 50")
both("rank_hybrid", lambda d: f"SELECT uri, origin, round(0.7 * score + 0.3 * {_weight}, 6) AS hybrid FROM results ORDER BY 0.7 * score + 0.3 * {_weight} DESC, uri, origin LIMIT 50")
both("search_adaptive", lambda d: f"WITH steps AS (SELECT k, 0.8 - 0.1 * k AS threshold FROM (SELECT 1 AS one) o{d.explode(d.sequence('0', '5'), 'k')}), hits AS (SELECT s.k, count(*) AS n FROM steps s JOIN results r ON r.score >= s.threshold GROUP BY s.k), pick AS (SELECT min(k) AS k FROM hits WHERE n >= 20) SELECT r.uri, r.origin, round(r.score, 6) AS score FROM pick p JOIN steps s ON s.k = p.k JOIN results r ON r.score >= s.threshold")
both("score_result_quality", lambda d: f"SELECT uri, round(least(1.0, CAST(0.5 + 0.3 * similarity + 0.2 * least(1.0, chars / 200.0) + 0.15 * greatest(0.0, 1 - ({d.seconds(NOW)} - {d.seconds('created')}) / 31536000.0) AS DOUBLE)), 6) AS quality FROM elements")
both("score_pan_boosts", lambda d: f"SELECT uri, round(CAST(similarity + 0.15 * {d.rx_count('lower(content)', 'the')} + CASE WHEN {d.rx('content', 'tion')} THEN 0.2 ELSE 0 END AS DOUBLE), 6) AS boosted FROM elements WHERE source IN ('src0', 'src1', 'src2')")
both("score_threshold", lambda d: "SELECT zoom, tilt, round(greatest(0.1, least(0.8, CASE zoom WHEN 'entity' THEN 0.6 WHEN 'unit' THEN 0.5 WHEN 'text' THEN 0.4 WHEN 'community' THEN 0.35 WHEN 'corpus' THEN 0.3 ELSE 0.5 END + CASE tilt WHEN 'click' THEN 0.05 WHEN 'error' THEN -0.1 ELSE 0 END)) * 1e0, 6) AS threshold, CAST(count(*) AS BIGINT) AS n FROM nav_views GROUP BY zoom, tilt")
both("score_zpt_selectivity", lambda d: "SELECT pan, zoom, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM nav_views), 6) AS selectivity FROM nav_views GROUP BY pan, zoom")
both("search_question_mapping", lambda d: "SELECT item_id, method, uri, score * 1e0 AS score FROM (SELECT b.item_id, 'mention' AS method, m.entity AS uri, 0.9 AS score FROM benchmark b JOIN mentions m ON m.doc_id = b.item_id UNION ALL SELECT b.item_id, 'neighbour', e.dst, 0.7 FROM benchmark b JOIN mentions m ON m.doc_id = b.item_id JOIN kg_edges e ON e.src = m.entity UNION ALL SELECT b.item_id, 'co-mention', y.entity, 0.5 FROM benchmark b JOIN mentions x ON x.doc_id = b.item_id JOIN mentions y ON y.doc_id = x.doc_id AND y.entity <> x.entity UNION ALL SELECT b.item_id, 'element', e.uri, 0.6 FROM benchmark b JOIN elements e ON e.doc_id = b.item_id UNION ALL SELECT b.item_id, 'view', v.corpuscle, 0.4 FROM benchmark b JOIN nav_views v ON v.view = b.item_id UNION ALL SELECT b.item_id, 'interaction', i.id, 0.3 FROM benchmark b JOIN interactions i ON i.conv_id = b.item_id UNION ALL SELECT b.item_id, 'region', e.dst, 0.2 FROM benchmark b JOIN kg_edges e ON e.src = concat('nation/', b.item_id % 25)) t")
both("search_result_context", lambda d: "SELECT context, value FROM (SELECT 'type' AS context, o AS value FROM kg_triples WHERE s = 'nation/5' AND p = 'rdf:type' UNION ALL SELECT 'label', o FROM kg_triples WHERE s = 'nation/5' AND p = 'rdfs:label' UNION ALL SELECT 'outgoing', dst FROM kg_edges WHERE src = 'nation/5' UNION ALL SELECT 'incoming', src FROM kg_edges WHERE dst = 'nation/5' UNION ALL SELECT 'document', concat('doc/', doc_id) FROM mentions WHERE entity = 'nation/5' UNION ALL SELECT 'viewed', session FROM nav_views WHERE corpuscle = 'nation/5' UNION ALL SELECT 'sibling', b.src FROM kg_edges a JOIN kg_edges b ON a.dst = b.dst AND b.src <> a.src WHERE a.src = 'nation/5' UNION ALL SELECT 'place', admin FROM places WHERE uri = 'nation/5') t")
both("search_related_by_uri", lambda d: "SELECT DISTINCT related, relation, weight * 1e0 AS weight FROM (SELECT dst AS related, 'out' AS relation, 1.0 AS weight FROM kg_edges WHERE src = 'supplier/5' UNION ALL SELECT src, 'in', 1.0 FROM kg_edges WHERE dst = 'supplier/5' UNION ALL SELECT b.dst, 'two-hop', 0.5 FROM kg_edges a JOIN kg_edges b ON a.dst = b.src WHERE a.src = 'supplier/5' AND b.dst <> 'supplier/5' UNION ALL SELECT y.entity, 'same-source', 0.4 FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id WHERE x.entity = 'supplier/5' AND y.entity <> 'supplier/5' UNION ALL SELECT b.src, 'same-target', 0.3 FROM kg_edges a JOIN kg_edges b ON a.dst = b.dst WHERE a.src = 'supplier/5' AND b.src <> a.src) t")
both("search_locations", lambda d: "SELECT e.uri, e.source, m.entity, l.quality FROM elements e LEFT JOIN mentions m ON m.doc_id = e.doc_id AND m.entity LIKE 'nation/%' LEFT JOIN labels l ON l.doc_id = e.doc_id WHERE e.type = 'TextElement' AND (e.modified IS NULL OR e.modified > TIMESTAMP '2024-02-01 00:00:00')")
both("search_enhancement_semantic", lambda d: "SELECT origin, id FROM (SELECT 'hyde' AS origin, concat('bench/', item_id) AS id, text FROM benchmark UNION ALL SELECT 'wikipedia', concat('doc/', doc_id), text FROM documents UNION ALL SELECT 'wikidata', uri, label FROM kg_nodes WHERE type = 'Nation') t WHERE contains(lower(text), 'an')")
both("search_unified", lambda d: "SELECT uri, origin, round(CAST(score * CASE origin WHEN 'exact' THEN 1.3 WHEN 'vector' THEN 1.2 ELSE 1.1 END * CASE type WHEN 'Entity' THEN 1.4 WHEN 'Unit' THEN 1.15 ELSE 1.0 END AS DOUBLE), 6) AS final FROM results ORDER BY CAST(score * CASE origin WHEN 'exact' THEN 1.3 WHEN 'vector' THEN 1.2 ELSE 1.1 END * CASE type WHEN 'Entity' THEN 1.4 WHEN 'Unit' THEN 1.15 ELSE 1.0 END AS DOUBLE) DESC, uri, origin LIMIT 50")
both("search_query_routing", lambda d: f"SELECT item_id, CASE WHEN {d.rx('lower(text)', '(^| )(who|where|when) ')} THEN 'entity' WHEN {d.rx('lower(text)', '(^| )(how|why) ')} THEN 'text' WHEN {d.rx('text', '[0-9]')} THEN 'graph' ELSE 'semantic' END AS service FROM benchmark")
both("search_resources_text", lambda d: "SELECT DISTINCT t.s, l.label FROM kg_triples t LEFT JOIN kg_nodes l ON l.uri = t.s WHERE contains(lower(t.o), 'nation_2') OR contains(lower(t.s), 'region/3')")
both("score_wikidata", lambda d: "SELECT uri, CASE WHEN lower(label) = 'nation_1' THEN 1.0 WHEN lower(label) LIKE 'nation_1%' THEN 0.8 WHEN contains(lower(label), '1') THEN 0.6 WHEN contains(lower(type), 'nat') THEN 0.3 ELSE 0.1 END * 1e0 AS relevance FROM kg_nodes WHERE type IN ('Nation', 'Region')")
both("score_wikipedia", lambda d: "SELECT uri, round(CAST(CASE WHEN contains(lower(label), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(content), 'the') THEN 0.3 ELSE 0 END + least(0.2, chars / 10000.0) AS DOUBLE), 6) AS relevance FROM elements")
both("score_web", lambda d: f"SELECT uri, round(CAST(s AS DOUBLE), 6) AS relevance FROM (SELECT uri, {' + '.join(f'CASE WHEN contains(lower(label), {chr(39)}{w}{chr(39)}) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(content), {chr(39)}{w}{chr(39)}) THEN 0.1 ELSE 0 END' for w in ('the', 'and', 'tion'))} AS s FROM elements) t WHERE s > 0.1")
both("score_concept_confidence", lambda d: f"SELECT doc_id, round(CAST(least(0.8, 0.2 * n) + CASE WHEN place > 0 AND place < 0.3 * chars THEN 0.2 ELSE 0 END AS DOUBLE), 6) AS confidence FROM (SELECT doc_id, {d.rx_count('lower(text)', 'tion')} AS n, {d.strpos('lower(text)', "'tion'")} AS place, {d.length('text')} AS chars FROM documents) t")
both("score_hypothesis", lambda d: f"SELECT id, round(CAST(least(1.0, 0.3 + least(0.3, length(output) / 1000.0) + least(0.2, {d.rx_count('output', '[.!?]')} / 20.0)) AS DOUBLE), 6) AS confidence FROM interactions")
both("hypo_query", lambda d: "SELECT t.s FROM (SELECT s, o FROM kg_triples WHERE p = 'rdf:type') t WHERE t.o = 'Supplier' AND EXISTS (SELECT 1 FROM kg_triples x WHERE x.s = t.s AND x.p = 'basedIn' AND x.o IN ('nation/1', 'nation/2', 'nation/3'))")
_boost = lambda d: "CASE split_part(DOM, ':', 1) WHEN 'instruction' THEN 1.5 WHEN 'user' THEN 1.2 WHEN 'session' THEN 0.8 ELSE 1.0 END"
_FOCUS = ("'project:1'", "'user:0'")
_relevance = lambda d: f"""
    SELECT id, domains, domain_match, temporal, frequency, greatest(0.001, least(1.0, (0.35 * domain_match + 0.2 * temporal + 0.3 * 0.5 + 0.15 * frequency)
      * {_boost(d).replace('DOM', d.at('domains', '1'))} * {_boost(d).replace('DOM', d.at('domains', '2'))})) AS relevance FROM (
      SELECT id, domains, CAST({d.size(d.intersect('domains', d.array(*_FOCUS)))} AS DOUBLE) / {d.size(d.union('domains', d.array(*_FOCUS)))} AS domain_match,
        exp(-greatest({d.seconds(NOW)} - {d.seconds('last_accessed')}, 0) / CASE WHEN {d.at('domains', '1')} LIKE 'user%' OR {d.at('domains', '1')} LIKE 'instruction%' THEN 31536000.0 ELSE 2592000.0 END) AS temporal,
        least(1.0, ln(1 + access_count) / ln(100) * 0.6 + importance * 0.4) AS frequency FROM memories) f"""  # noqa: E731
both("score_mem_relevance", lambda d: f"SELECT id, round(domain_match, 6) AS domain_match, round(temporal, 6) AS temporal, round(frequency, 6) AS frequency, round(CAST(relevance AS DOUBLE), 6) AS relevance FROM ({_relevance(d)}) r")
both("score_mem_domain", lambda d: f"SELECT id, round(CAST({d.size(d.intersect('domains', d.array(*_FOCUS)))} AS DOUBLE) / greatest({d.size('domains')}, 2), 6) AS overlap FROM memories")
both("mem_visible", lambda d: f"SELECT id, round(CAST(relevance AS DOUBLE), 6) AS relevance FROM ({_relevance(d)}) r WHERE relevance > 0.3 ORDER BY round(CAST(relevance AS DOUBLE), 6) DESC, id LIMIT 100")
both("mem_recover_hidden", lambda d: f"SELECT id, round(CAST(relevance AS DOUBLE), 6) AS relevance FROM ({_relevance(d)}) r WHERE relevance < 0.3 ORDER BY round(CAST(relevance AS DOUBLE), 6) DESC, id LIMIT 20")
both("mem_fade", lambda d: "SELECT id, CASE WHEN id % 10 = 0 THEN importance * 0.1 ELSE importance END AS factor FROM memories")
both("mem_context_build", lambda d: f"SELECT topic, CAST(count(*) AS BIGINT) AS n, {d.words_joined('id', ',')} AS examples FROM (SELECT {d.at('concepts', '1')} AS topic, id, row_number() OVER (PARTITION BY {d.at('concepts', '1')} ORDER BY ts DESC, id) AS r FROM interactions) t WHERE r <= 5 GROUP BY topic")
both("rag_context_combine", lambda d: f"SELECT {d.words_joined('piece', ' | ', False, 'section, r')} AS context FROM (SELECT 1 AS section, r, concat('P:', substring(prompt, 1, 40)) AS piece FROM (SELECT prompt, row_number() OVER (PARTITION BY turn ORDER BY ts DESC, id) AS r, turn FROM interactions WHERE turn = 0) a WHERE r <= 3 UNION ALL SELECT 2, r, concat('D:', substring(content, 1, 40)) FROM (SELECT content, row_number() OVER (PARTITION BY type ORDER BY similarity DESC, uri) AS r, type FROM elements WHERE type = 'Unit') b WHERE r <= 3) p")
both(
    "score_community_confidence",
    lambda d: f"""
    WITH members AS (SELECT dst AS community, src AS member FROM kg_edges WHERE type IN ('basedIn', 'livesIn')),
    sizes AS (SELECT community, count(*) AS n FROM members GROUP BY community),
    units AS (SELECT c.community, count(DISTINCT m.doc_id) AS n FROM members c JOIN mentions m ON m.entity = c.member GROUP BY c.community),
    links AS (SELECT c.community, count(*) AS n FROM members c JOIN (SELECT src AS x FROM kg_edges UNION ALL SELECT dst FROM kg_edges) e ON e.x = c.member GROUP BY c.community),
    summary AS (SELECT dst AS community, sum({d.length('label')} + 2) AS n FROM kg_edges e JOIN kg_nodes k ON k.uri = e.src WHERE e.type = 'basedIn' GROUP BY dst)
    SELECT s.community, round(CAST(least(1.0, 0.3 + CASE WHEN s.n > 2 THEN least(s.n * 0.1, 0.3) ELSE 0 END + least(coalesce(u.n, 0) * 0.05, 0.2) + least(coalesce(l.n, 0) * 0.05, 0.15) + CASE WHEN coalesce(t.n, 0) > 100 THEN 0.1 ELSE 0 END) AS DOUBLE), 6) AS confidence
    FROM sizes s LEFT JOIN units u ON u.community = s.community LEFT JOIN links l ON l.community = s.community LEFT JOIN summary t ON t.community = s.community""",
)
both("score_community_cohesion", lambda d: "SELECT c.dst AS community, CAST(count(*) AS BIGINT) AS members, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS documents FROM kg_edges c JOIN mentions m ON m.entity = c.src WHERE c.type = 'basedIn' GROUP BY c.dst")
both("score_community_link", lambda d: "WITH members AS (SELECT c.dst AS community, m.doc_id FROM kg_edges c JOIN mentions m ON m.entity = c.src WHERE c.type = 'basedIn' UNION SELECT entity, doc_id FROM mentions WHERE entity LIKE 'nation/%'), sizes AS (SELECT community, count(DISTINCT doc_id) AS n FROM members GROUP BY community) SELECT one, other, round(shared * 1.0 / least(na, nb), 6) AS strength FROM (SELECT a.community AS one, b.community AS other, count(DISTINCT a.doc_id) AS shared, max(x.n) AS na, max(y.n) AS nb FROM members a JOIN members b ON a.doc_id = b.doc_id AND a.community < b.community JOIN sizes x ON x.community = a.community JOIN sizes y ON y.community = b.community GROUP BY a.community, b.community) t WHERE shared * 1.0 / least(na, nb) > 0.01".replace("round(shared * 1.0 / least(na, nb), 6)", "round(CAST(shared AS DOUBLE) / least(na, nb), 6)"))
both("zpt_keyword_ranking", lambda d: f"SELECT uri, {d.rx_count('lower(content)', 'tion|the')} AS hits FROM elements ORDER BY {d.rx_count('lower(content)', 'tion|the')} DESC, uri LIMIT 50")
both("zpt_graph_ranking", lambda d: "SELECT uri, degree FROM (SELECT a AS uri, CAST(count(*) AS BIGINT) AS degree FROM kg_adj GROUP BY a) g ORDER BY degree DESC, uri LIMIT 50")
both("zpt_similarity_ranking", lambda d: "SELECT uri, similarity FROM elements ORDER BY similarity DESC, uri LIMIT 50")
both("zpt_temporal_ranking", lambda d: "SELECT uri, coalesce(modified, created) AS at FROM elements ORDER BY coalesce(modified, created) DESC, uri LIMIT 50")
# Navigation: levels of abstraction by ways of ranking, each one plan.
_ZOOMS = {
    "entity": "SELECT uri, type, label, score, freq FROM kg_nodes WHERE type <> 'Part'",
    "unit": "SELECT uri, type, label, similarity AS score, coalesce(access_count, 0) AS freq FROM elements WHERE type = 'Unit'",
    "text": "SELECT uri, type, label, similarity AS score, coalesce(access_count, 0) AS freq FROM elements",
    "community": "SELECT e.dst AS uri, 'Community' AS type, e.dst AS label, avg(n.score) AS score, CAST(count(*) AS BIGINT) AS freq FROM kg_edges e JOIN kg_nodes n ON n.uri = e.src WHERE e.type <> 'suppliedBy' GROUP BY e.dst",
    "corpus": "SELECT source AS uri, 'Corpus' AS type, source AS label, avg(similarity) AS score, CAST(count(*) AS BIGINT) AS freq FROM elements GROUP BY source",
}
_TILTS = {"keywords": "label", "similarity": "round(score + 1e-9, 6) DESC, uri", "frequency": "freq DESC, uri"}
for _zoom, _sql in _ZOOMS.items():
    for _tilt, _order in _TILTS.items():
        both(f"navigate_{_zoom}_{_tilt}", lambda d, s=_sql, o=_order: f"SELECT uri, type, label, round(score + 1e-9, 6) AS score, freq FROM ({s}) z ORDER BY {o}{', uri' if o == 'label' else ''} LIMIT 100")
