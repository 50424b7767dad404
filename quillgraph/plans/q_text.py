"""Chunking, decomposition, projections and formats of texts, and similarity links between vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text, vectors
from .registry import both, frame, view

both("chunk_fixed", lambda d: f"SELECT doc_id, CAST(k AS BIGINT) AS chunk, substring(text, CAST(k * 900 + 1 AS INT), 1000) AS content FROM (SELECT doc_id, text, k FROM documents{d.explode(d.sequence('0', 'CAST(floor((length(text) - 1) / 900.0) AS INT)'), 'k')}) t")
for _name in ("semantic", "adaptive", "hierarchical", "token_aware"):
    frame(f"chunk_{_name}", lambda spark, sf, n=_name: text.chunk(view(spark, sf, "documents"), n).select("id", "chunk", "start", "size", "hash"))
frame("ctx_windows", lambda spark, sf: text.chunk(view(spark, sf, "documents"), "windows").select("id", "chunk", "start", "size"))
frame("chunk_document", lambda spark, sf: text.chunk(view(spark, sf, "documents"), "auto").groupBy("id").agg(F.count("*").alias("chunks"), F.when(F.count("*") == 1, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.stddev_pop("size") / F.avg("size")), 2)).alias("cohesion")))
both("chunk_strategy_select", lambda d: f"SELECT doc_id, CASE WHEN {d.rx('text', '(^|\\n)#{1,6} ')} THEN 'hierarchical' ELSE 'semantic' END AS strategy FROM documents")
both("chunk_boundaries", lambda d: f"SELECT doc_id, {d.rx_count('text', '\\n[ \\t\\n]*\\n')} AS paragraphs, {d.rx_count('text', '[.!?]+[ \\t\\n]+[A-Z]')} AS sentences, {d.rx_count('text', '\\n#+[ \\t\\n]+')} AS sections FROM documents")
both("chunk_corpuscles", lambda d: "SELECT type, CAST(floor(before / 4000.0) AS BIGINT) AS pack, CAST(count(*) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT type, chars, sum(chars) OVER (PARTITION BY type ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - chars AS before FROM elements) t GROUP BY type, CAST(floor(before / 4000.0) AS BIGINT)")
both("chunk_overlap_merge", lambda d: "SELECT conv_id, turn, length(text) < 80 AND lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) < 80 AS merge_next FROM conversations")
both("decompose", lambda d: f"SELECT lower(w) AS entity, CAST(count(*) AS BIGINT) AS frequency, count(DISTINCT item_id) AS units FROM (SELECT item_id, w FROM benchmark{d.explode(d.rx_all('text', '[A-Z][a-z]+'), 'w')}) t GROUP BY lower(w)")
both("extract_relationships", lambda d: "SELECT a.entity AS source, b.entity AS target, CAST(count(*) AS BIGINT) AS weight, min(a.doc_id) AS first_unit FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY a.entity, b.entity")
both("augment_attributes", lambda d: "SELECT n.uri, concat(n.label, ' is a ', lower(n.type), ' with ', CAST(coalesce(g.k, 0) AS STRING), ' links') AS attribute FROM kg_nodes n LEFT JOIN (SELECT a, count(*) AS k FROM kg_adj GROUP BY a) g ON g.a = n.uri WHERE n.score >= 0.5".replace("STRING", "STRING" if d.name == "spark" else "VARCHAR"))


def _hashed(table: str, key: str) -> str:
    """The signed 32-bit rolling hash h = 31 h + unit over UTF-16 units of each text."""
    code = "unicode(c)"
    units = f"flatten(list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: CASE WHEN {code} < 65536 THEN [{code}] ELSE [55296 + (({code} - 65536) >> 10), 56320 + (({code} - 65536) & 1023)] END))"
    return f"SELECT {key}, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM (SELECT {key}, list_reduce(list_transform({units}, lambda c: CAST(c AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS u FROM {table}) y"


def _place(h: str, i: str) -> str:
    """Entry i of the embedding that stands in for a model's."""
    at = f"({h} + 31 * {i})"
    return f"(CASE WHEN {at} >= 0 THEN 1 ELSE -1 END * (abs({at}) % 1000) / 1000e0 - 0.5)"


frame("enrich_embeddings", lambda spark, sf: text.hash_embeddings(view(spark, sf, "SELECT doc_id, text FROM documents")).select("id", F.size("v").alias("dims"), F.round(F.element_at("v", 1), 6).alias("lead")), lambda d: f"SELECT doc_id AS id, 64 AS dims, round({_place('h', '0')}, 6) AS lead FROM ({_hashed('documents', 'doc_id')}) x")
frame("vec_hash_embedding", lambda spark, sf: text.hash_embeddings(view(spark, sf, "benchmark"), 16, id_col="item_id").select("id", F.transform("v", lambda x: F.round(x, 3)).alias("v")), lambda d: f"SELECT item_id AS id, list_transform(range(16), lambda i: round({_place('h', 'i')}, 3)) AS v FROM ({_hashed('benchmark', 'item_id')}) x")
both("aggregate_communities", lambda d: f"SELECT e.dst AS community, CAST(count(*) AS BIGINT) AS members, {d.words_joined('n.label', ', ')} AS summary FROM kg_edges e JOIN kg_nodes n ON n.uri = e.src WHERE e.type = 'basedIn' GROUP BY e.dst")
both("corpus_projection_concept", lambda d: "SELECT lower(concept) AS concept, CAST(count(*) AS BIGINT) AS frequency, CAST(count(DISTINCT item) AS BIGINT) AS items FROM concepts GROUP BY lower(concept)")
both("corpus_projection_keywords", lambda d: f"SELECT w AS keyword, CAST(count(*) AS BIGINT) AS n, round(CAST(count(DISTINCT item_id) AS DOUBLE) / (SELECT count(*) FROM benchmark), 6) AS coverage FROM (SELECT item_id, w FROM benchmark{d.explode(d.rx_split('lower(text)', '[^a-z]+'), 'w')}) t WHERE length(w) >= 4 GROUP BY w")
both("corpus_projection_embedding", lambda d: f"SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(norm), 5) AS mean_norm FROM (SELECT label, sqrt({d.zip_sum('v', 'v', 'CAST(x AS DOUBLE) * CAST(y AS DOUBLE)')}) AS norm FROM vectors) t GROUP BY label")
both("corpus_projection_temporal", lambda d: f"SELECT {d.date_text('created', 'yyyy-MM', '%Y-%m')} AS month, CAST(count(*) AS BIGINT) AS n, min(uri) AS first_uri FROM elements GROUP BY {d.date_text('created', 'yyyy-MM', '%Y-%m')}")
both("format_output", lambda d: "SELECT uri, concat('## ', label, chr(10), chr(10), substring(content, 1, 120)) AS markdown, concat('{\"uri\":\"', uri, '\",\"type\":\"', type, '\"}') AS json FROM elements")
both("encode_metadata", lambda d: "SELECT uri, concat('[', type, '|', source, '|', lang, ']') AS header, concat(uri, ';', type) AS compact FROM elements")
both("decode_metadata", lambda d: f"SELECT uri, {d.rx_extract('header', '^.([^|]*).')} AS type, split_part(header, '|', 2) AS source FROM (SELECT uri, concat('[', type, '|', source, '|', lang, ']') AS header FROM elements) t")
both("transform_pipeline", lambda d: f"SELECT doc_id, tokens, CASE WHEN tokens <= 250 THEN 1 ELSE CAST(ceil(tokens / 225.0) AS BIGINT) END AS chunks, concat('<!-- tokens ', CAST(tokens AS STRING), ' -->') AS header FROM (SELECT doc_id, CAST(ceil({d.length('text')} / 4.0) AS BIGINT) AS tokens FROM documents) t".replace("STRING", "STRING" if d.name == "spark" else "VARCHAR"))
both("label_elements", lambda d: f"SELECT doc_id, {d.least_by('w', 'r')} AS label FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM (SELECT d.doc_id, w, count(*) AS n FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) d{d.explode(d.rx_split('d.low', '[^a-z]+'), 'w')} WHERE length(w) >= 4 GROUP BY d.doc_id, w) k) t WHERE r = 1 GROUP BY doc_id")
both("create_concepts", lambda d: "SELECT DISTINCT concat('concept/', lower(replace(concept, '#', '-'))) AS uri, concept FROM concepts WHERE concept NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_retailprice) < (SELECT avg(p_retailprice) FROM part))")
both("normalise_params_complexity", lambda d: "SELECT zoom, tilt, least(10, CASE zoom WHEN 'micro' THEN 5 WHEN 'entity' THEN 4 WHEN 'unit' THEN 3 WHEN 'text' THEN 2 ELSE 1 END + CASE tilt WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 3 END) AS complexity, CAST(count(*) AS BIGINT) AS n FROM nav_views GROUP BY zoom, tilt")
both("selectivity_rules", lambda d: "SELECT zoom, round(CAST(CASE zoom WHEN 'micro' THEN 0.1 WHEN 'entity' THEN 0.2 WHEN 'unit' THEN 0.3 WHEN 'text' THEN 0.5 ELSE 0.8 END * count(DISTINCT pan) / 10 AS DOUBLE), 6) AS selectivity FROM nav_views GROUP BY zoom")
both("limit_token_budget", lambda d: "SELECT type, source, budget, least(CAST(floor(budget * 0.8 / 50) AS BIGINT), 1000) AS rows FROM (SELECT type, source, CAST(ceil(sum(chars) / 4.0) AS BIGINT) AS budget FROM elements GROUP BY type, source) b".replace(" AS rows ", " AS max_rows "))


def _first_kept(rows: str, threshold: float) -> str:
    """One row after the other in each source, with the rows kept so far."""
    return f"""
        WITH RECURSIVE w AS (SELECT source, doc_id, list_distinct(regexp_extract_all(lower(text), '[^\\s]+')) AS ws, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM {rows} r),
        matched AS (SELECT a.source, a.i AS one, b.i AS other, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) + len(b.ws) AS total FROM w a JOIN w b ON a.source IS NOT DISTINCT FROM b.source AND a.i < b.i AND len(a.ws) >= {threshold} * len(b.ws) AND len(b.ws) >= {threshold} * len(a.ws)),
        near AS (SELECT source, other AS i, list(one) AS earlier FROM matched WHERE n > 0 AND CAST(n AS DOUBLE) / (total - n) >= {threshold} GROUP BY source, other),
        walk AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT source FROM w) s
          UNION ALL SELECT k.source, w.i, CASE WHEN list_has_any(k.kept, coalesce(n.earlier, [])) THEN k.kept ELSE list_append(k.kept, w.i) END
          FROM walk k JOIN w ON w.source IS NOT DISTINCT FROM k.source AND w.i = k.i + 1 LEFT JOIN near n ON n.source IS NOT DISTINCT FROM w.source AND n.i = w.i)
        SELECT w.source, w.doc_id FROM w JOIN (SELECT source, max_by(kept, i) AS kept FROM walk GROUP BY source) k ON w.source IS NOT DISTINCT FROM k.source AND list_contains(k.kept, w.i)"""


#: One element after the other in each type, with what is left of the budget.
_PACKED = """
    WITH RECURSIVE items AS (SELECT type, doc_id, CAST(ceil(chars / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY type ORDER BY similarity DESC, doc_id) AS i FROM elements),
    walk AS (SELECT type, CAST(0 AS BIGINT) AS i, CAST(2000 AS BIGINT) AS rest, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT type FROM items) t
      UNION ALL SELECT w.type, x.i, CASE WHEN x.tokens <= w.rest THEN w.rest - x.tokens ELSE w.rest END, CASE WHEN x.tokens <= w.rest THEN list_append(w.taken, x.doc_id) ELSE w.taken END FROM walk w JOIN items x ON x.type = w.type AND x.i = w.i + 1)
    SELECT type, unnest(taken) AS doc_id FROM (SELECT type, max_by(taken, i) AS taken FROM walk GROUP BY type) t"""
frame("set_dedup_content", lambda spark, sf: text.dedup_content(view(spark, sf, "documents"), group_col="source", key_col="doc_id", text_col="text", order_col="doc_id"), lambda d: _first_kept("documents", 0.8))
frame("set_dedup_hybrid", lambda spark, sf: text.dedup_content(view(spark, sf, "SELECT source, doc_id, min(text) AS text FROM documents GROUP BY source, doc_id"), group_col="source", key_col="doc_id", text_col="text", order_col="doc_id", threshold=0.9), lambda d: _first_kept("(SELECT source, doc_id, min(text) AS text FROM documents GROUP BY source, doc_id)", 0.9))
frame("topk_token_knapsack", lambda spark, sf: text.pack_tokens(view(spark, sf, "SELECT type, doc_id, similarity, CAST(ceil(chars / 4.0) AS INT) AS tokens FROM elements"), 2000, group_col="type", key_col="doc_id", priority_col="similarity", tokens_col="tokens"), lambda d: _PACKED)
#: All pairs of vectors, each with its place among those of one of them.
_NEAR = "near AS (SELECT a.vec_id AS one, b.vec_id AS other, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS r FROM (SELECT x.vec_id, y.vec_id AS other, list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])) AS s FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id) a JOIN vectors b ON b.vec_id = a.other)"
frame("sim_links", lambda spark, sf: vectors.links(view(spark, sf, "vectors"), k=10).select("a", "b", F.round("similarity", 5).alias("similarity")), lambda d: f"WITH {_NEAR}, top AS (SELECT one, other, s FROM near WHERE r <= 10) SELECT least(one, other) AS a, greatest(one, other) AS b, round(max(s), 5) AS similarity FROM top GROUP BY least(one, other), greatest(one, other)")
both("html_source", lambda d: f"SELECT page_id, {d.length(d.rx_replace(d.rx_replace(d.rx_replace('html', '(?is)<(script|style)[^>]*>.*?</(script|style)>', ''), '<[^>]*>', ' '), '[ \\n\\t]+', ' '))} AS chars FROM pages")
both("export_ntriples", lambda d: "SELECT concat('<', s, '> <', p, '> ', CASE WHEN p = 'rdfs:label' THEN concat(chr(34), o, chr(34)) ELSE concat('<', o, '>') END, ' .') AS line FROM kg_triples")
both("export_graph_api", lambda d: "SELECT s, p, o FROM kg_triples WHERE p <> 'suppliedBy' ORDER BY s, p, o LIMIT 500")


def _hash31(spark, sf):
    """Rolling 31-hash of labels over 32 bits, its size and sign aside in base 36."""
    units = F.filter(F.split("label", ""), lambda c: c != "")
    whole = F.aggregate(F.transform(units, F.ascii), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    signed = F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole)
    return view(spark, sf, "SELECT uri, label FROM kg_nodes").select("uri", signed.alias("h")).select("uri", "h", F.lower(F.conv(F.abs("h").cast("string"), 10, 36)).alias("name"))


frame(
    "str_hash31", _hash31,
    lambda d: "SELECT uri, h, lower(to_base(abs(h), 36)) AS name FROM (SELECT uri, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS h FROM (SELECT uri, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(label, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS w FROM kg_nodes) x) y",
)

frame("chunk_balance", lambda spark, sf: text.chunk(view(spark, sf, "documents"), "balanced").select("id", "chunk", "start", "size", "hash"))
