"""Scalar functions of strings, numbers, dates, vectors and JSON, as columns over the tables."""

from __future__ import annotations

from .kg import NOW
from .registry import both

# Strings and hashes.
both("str_contains_lcase_concat", lambda d: f"SELECT uri, contains(label, 'th') AS has, lower(label) AS low, concat(type, ':', uri) AS joined, substring(label, 2, 5) AS part, {d.length('label')} AS n, replace(label, 'th', 'TH') AS swapped, CASE WHEN contains(label, ' ') THEN substring(label, CAST({d.strpos('label', chr(39) + ' ' + chr(39))} AS INT) + 1, 1000) ELSE '' END AS after FROM elements")
both("str_escape", lambda d: "SELECT doc_id, replace(replace(replace(substring(text, 1, 1000), '\"', '\\\\\"'), chr(10), '\\\\n'), chr(9), '\\\\t') AS escaped FROM documents" if d.name == "spark" else "SELECT doc_id, replace(replace(replace(substring(text, 1, 1000), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t') AS escaped FROM documents")
both("str_slug_uri", lambda d: f"SELECT p_partkey, {d.rx_replace(d.rx_replace('lower(p_name)', '[^a-z0-9]+', '-'), '^-+|-+$', '')} AS slug FROM part")
both("str_hash16", lambda d: f"SELECT doc_id, substring({d.sha256('text')}, 1, 16) AS hash FROM documents")
both("str_md5_uri", lambda d: "SELECT doc_id, concat('content/', md5(text)) AS uri FROM documents")
both("str_title", lambda d: f"SELECT doc_id, CASE WHEN length(line) < 100 AND NOT {d.rx('line', '[.!?]$')} THEN line END AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents) t")
both("str_filename", lambda d: f"SELECT page_id, {d.rx_extract('url', '([^/]*)$')} AS name FROM pages")
both("str_truncate", lambda d: "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS short FROM documents")
both("str_jaccard_words", lambda d: f"SELECT item_id, other, round(CAST({d.size(d.intersect('wa', 'wb'))} AS DOUBLE) / {d.size(d.union('wa', 'wb'))}, 6) AS jaccard FROM (SELECT a.item_id, b.item_id AS other, {d.distinct(d.rx_split('lower(a.text)', '[ \\t\\n]+'))} AS wa, {d.distinct(d.rx_split('lower(b.text)', '[ \\t\\n]+'))} AS wb FROM (SELECT item_id, text FROM benchmark) a CROSS JOIN (SELECT item_id, text FROM benchmark) b) t")
both("str_partial_match", lambda d: f"SELECT doc_id, round({d.total(d.map(d.array(*[chr(39) + w + chr(39) for w in ('the', 'and', 'tion', 'zzz')]), 'x', 'CASE WHEN contains(lower(text), x) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END'))} / 4, 6) AS matched FROM documents")
_words = lambda d, table, key: f"SELECT {key}, w, CAST(count(*) AS BIGINT) AS n FROM (SELECT {key}, w FROM {table}{d.explode(d.rx_split('lower(text)', '[^a-z0-9]+'), 'w')}) t WHERE length(w) >= 4 AND w NOT IN ('this', 'that', 'with', 'from', 'have', 'they', 'were') GROUP BY {key}, w"
both("str_keywords", lambda d: f"SELECT doc_id, w AS keyword, n FROM (SELECT doc_id, w, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM ({_words(d, 'documents', 'doc_id')}) k) t WHERE r <= 5")
both("str_keyword_score", lambda d: f"SELECT doc_id, w AS keyword, round(CAST(n AS DOUBLE) / total * 1.1, 6) AS score FROM (SELECT doc_id, w, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM ({_words(d, 'documents', 'doc_id')}) k) t WHERE CAST(n AS DOUBLE) / total * 1.1 >= 0.02")
both("str_keyword_occurrences", lambda d: f"SELECT doc_id, round(CAST({d.rx_count('lower(text)', 'the')} + {d.rx_count('lower(text)', 'tion')} AS DOUBLE) / 2, 6) AS score FROM documents")
both("str_pluralize_expand", lambda d: "SELECT DISTINCT term, CASE WHEN right(term, 1) = 's' THEN substring(term, 1, length(term) - 1) ELSE concat(term, 's') END AS other FROM (SELECT lower(label) AS term FROM kg_nodes WHERE type IN ('Nation', 'Region')) t")
both("str_capitalised_entities", lambda d: f"SELECT doc_id, {d.size(d.rx_all('text', '[A-Z][a-z]+( [A-Z][a-z]+)*'))} AS spans, {d.at(d.rx_all('text', '[A-Z][a-z]+( [A-Z][a-z]+)*'), '1')} AS first_span FROM documents")
both("str_sentence_split", lambda d: f"SELECT doc_id, {d.size(d.keep(d.map(d.rx_split('text', '[.!?]+'), 'x', 'trim(x)'), 'x', 'length(x) > 10'))} AS sentences FROM documents")
both("str_search_terms", lambda d: f"SELECT item_id, {d.join(d.slice(d.keep(d.rx_split('lower(text)', '[^a-z0-9]+'), 'x', 'length(x) > 2'), '1', '5'), ' ')} AS terms FROM benchmark")
both("str_html_entities", lambda d: "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS clean FROM pages")
both("str_html_metadata", lambda d: f"SELECT page_id, {d.rx_extract('html', '<title>([^<]*)</title>')} AS title, {d.rx_extract('html', '<html[^>]*lang=.([a-zA-Z-]+)')} AS lang, {d.rx_count('html', '<h[1-6][ >]')} AS headings, {d.rx_count('html', '<p[ >]')} AS paragraphs, {d.rx_count('html', '<a[ >]')} AS links, {d.rx_count('html', '<img[ >]')} AS images FROM pages")
both("str_html_clean", lambda d: f"SELECT page_id, {d.rx_replace(d.rx_replace(d.rx_replace('html', '(?is)<script.*?</script>', ''), '(?is)<style.*?</style>', ''), '(?s)<!--.*?-->', '')} AS clean FROM pages")
both("str_html_validate", lambda d: f"SELECT page_id, {d.rx('html', '<[a-zA-Z][^>]*>')} AS has_tags, {d.rx_count('html', '<div')} = {d.rx_count('html', '</div')} AS balanced_divs FROM pages")
both("str_content_type", lambda d: f"SELECT uri, CASE WHEN {d.rx('content', '^[ \\n]*[\\[{]')} THEN 'json' WHEN {d.rx('content', '<[a-z]+[^>]*>')} THEN 'html' WHEN {d.rx('content', '(^|\\n)#{1,6} ')} THEN 'markdown' WHEN {d.rx('content', '\\n- ')} THEN 'structured' ELSE 'plain' END AS kind FROM (SELECT uri, content FROM elements UNION ALL SELECT url, html FROM pages) t")
both("str_token_simple", lambda d: f"SELECT doc_id, CAST(greatest(1, ceil({d.length('text')} / 4.0)) AS BIGINT) AS tokens FROM documents")
both("str_token_advanced", lambda d: f"SELECT doc_id, CAST(greatest(1, floor(0.5 + ((base * 1.1) * CASE WHEN code THEN 1.3 ELSE 1.0 END + urls * 2 + numbers * 0.5) * CASE WHEN marks / n > 0.1 THEN 1 + marks / n ELSE 1 END + alien * 0.5)) AS BIGINT) AS tokens FROM (SELECT doc_id, CAST({d.length('text')} AS DOUBLE) AS n, ceil({d.length('text')} / 4.0) * 1e0 AS base, {d.rx('text', 'function +[a-zA-Z0-9_]+ *[(]|class +[a-zA-Z0-9_]+|import +[a-zA-Z0-9_]+|def +[a-zA-Z0-9_]+ *[(]|console[.]log|print *[(]')} AS code, {d.rx_count('text', 'https?://[^ \\n\\t]+')} AS urls, {d.rx_count('text', '[0-9]+')} AS numbers, CAST({d.rx_count('text', '[.,;:!?(){}]')} AS DOUBLE) AS marks, {d.rx_count('text', '[^a-zA-Z0-9 \\n\\t!-~]')} AS alien FROM documents WHERE length(text) > 0) t")
both("str_cost", lambda d: f"SELECT doc_id, round(tokens * 0.00003 + 100 * 0.00006, 9) AS cost FROM (SELECT doc_id, ceil({d.length('text')} / 4.0) * 1e0 AS tokens FROM documents) t")
both("str_context_fit", lambda d: f"SELECT doc_id, tokens <= 15385 AS fits, round(tokens / 15385.0, 6) AS utilisation, CASE WHEN tokens / 15385.0 > 1 THEN 'split' WHEN tokens / 15385.0 > 0.8 THEN 'near limit' ELSE 'ok' END AS advice FROM (SELECT doc_id, ceil({d.length('text')} / 4.0) * 1e0 AS tokens FROM documents) t")
both("str_query_analysis", lambda d: f"SELECT item_id, words, CASE WHEN words <= 3 THEN 'simple' WHEN words <= 10 THEN 'moderate' ELSE 'complex' END AS complexity, CASE WHEN {d.rx('lower(text)', '^(what|who|when|where|why|how) ')} THEN 'question' ELSE 'statement' END AS kind, round(CAST(long_words AS DOUBLE) / words, 6) AS density FROM (SELECT item_id, text, {d.size(d.keep(d.rx_split('text', '[ \\n]+'), 'x', 'length(x) > 0'))} AS words, {d.size(d.keep(d.rx_split('text', '[ \\n]+'), 'x', 'length(x) > 6'))} AS long_words FROM benchmark) t")

# Numbers.
both("math_normalise_minmax", lambda d: "SELECT uri, origin, round(CASE WHEN b = a THEN 1.0 ELSE (score - a) / (b - a) END, 6) AS normal FROM results, (SELECT min(score) AS a, max(score) AS b FROM results) r")
both("math_normalise_zscore", lambda d: "SELECT uri, origin, round(CASE WHEN s = 0 THEN 0.0 ELSE (score - m) / s END, 5) AS normal FROM results, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM results) r")
both("math_normalise_sigmoid", lambda d: "SELECT uri, origin, round(1 / (1 + exp(-score)), 6) AS normal FROM results")
both("math_temporal_decay", lambda d: f"SELECT id, round(exp(-greatest({d.seconds(NOW)} - {d.seconds('last_accessed')}, 0) / 2592000.0), 6) AS project, round(exp(-greatest({d.seconds(NOW)} - {d.seconds('last_accessed')}, 0) / 31536000.0), 6) AS permanent FROM memories")
both("math_recency_bonus", lambda d: f"SELECT event_id, CASE WHEN age < 3600 THEN round((1 - age / 3600.0) * 0.2, 6) ELSE 0.0 END * 1e0 AS bonus FROM (SELECT event_id, {d.seconds('(SELECT max(ts) FROM events)')} - {d.seconds('ts')} AS age FROM events) t")
both("math_frequency", lambda d: "SELECT id, round(ln(1 + access_count) / ln(100), 6) AS by_hundred, round(ln(1 + access_count) / 10, 6) AS by_ten FROM memories")
both("math_yearly_decay", lambda d: f"SELECT uri, round(greatest(0.0, 1 - ({d.seconds(NOW)} - {d.seconds('created')}) / 31536000.0 / 5), 6) AS five_years, round(greatest(0.0, 1 - ({d.seconds(NOW)} - {d.seconds('created')}) / 86400.0 / 365), 6) AS one_year FROM elements")
_Q = "(SELECT v AS q FROM vectors WHERE vec_id = 0) q0"
both("math_schedule", lambda d: f"SELECT id, t, round(0.1 * (1 - t / 100.0), 9) AS linear, round(0.1 * exp(-3.0 * t / 100), 9) AS exponential, round(0.1 / (1 + t / 20.0), 9) AS inverse, round(0.1 * power(0.5, floor(t / 25.0)), 9) AS step FROM (SELECT id, CAST(access_count AS DOUBLE) AS t FROM memories) s")
both("math_neighbourhood", lambda d: f"SELECT vec_id, x, round(exp(-x * x / (2 * 1.0)), 6) AS gaussian, round((1 - x * x) * exp(-x * x / 2), 6) AS mexican, CASE WHEN x <= 3 THEN 1.0 ELSE 0.0 END * 1e0 AS bubble, greatest(0.0, 1 - x / 3) AS linear FROM (SELECT vec_id, round(3 * sqrt({d.zip_sum('v', 'q', '(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))')}), 4) AS x FROM vectors, {_Q}) s".replace("greatest(0.0, 1 - x / 3)", "round(greatest(0.0, 1 - x / 3), 6)"))
both("math_geo_area", lambda d: "SELECT admin, round((max(lat) - min(lat)) * (max(lon) - min(lon)), 6) AS box, round(3.141592653589793 * power((max(lat) - min(lat)) / 2, 2), 6) AS circle FROM places GROUP BY admin")

# Dates.
both("date_bucket", lambda d: f"SELECT event_id, {d.date_text('ts', 'yyyy', '%Y')} AS year, {d.date_text('ts', 'yyyy-MM', '%Y-%m')} AS month, {d.date_text('ts', 'yyyy-MM-dd', '%Y-%m-%d')} AS day, {d.date_text('ts', 'yyyy-MM-dd-HH', '%Y-%m-%d-%H')} AS hour FROM events")
both("date_bucket_range", lambda d: "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, last_day(CAST(o_orderdate AS DATE)) AS final_day FROM orders")
both("date_duration_days", lambda d: f"SELECT uri, CAST(ceil(({d.seconds(NOW)} - {d.seconds('created')}) / 86400.0) AS BIGINT) AS days FROM elements")
both("date_relative_parse", lambda d: f"SELECT e.event_id, u.span FROM events e JOIN (SELECT '7d' AS span, 7 * 86400 AS s UNION ALL SELECT '3h', 3 * 3600 UNION ALL SELECT '30m', 30 * 60) u ON {d.seconds('e.ts')} >= {d.seconds('(SELECT max(ts) FROM events)')} - u.s")
both("date_event_frequency", lambda d: f"SELECT user_id, round(CAST(count(*) AS DOUBLE) / ((max({d.seconds('ts')}) - min({d.seconds('ts')})) / 86400.0), 4) AS per_day FROM events GROUP BY user_id HAVING max({d.seconds('ts')}) > min({d.seconds('ts')})")

# Arrays and vectors, against the vector with the smallest id.
_dot = lambda d: d.zip_sum("v", "q", "CAST(x AS DOUBLE) * CAST(y AS DOUBLE)")
_norm = lambda d, a: f"sqrt({d.zip_sum(a, a, 'CAST(x AS DOUBLE) * CAST(y AS DOUBLE)')})"
cosine = lambda d: f"{_dot(d)} / nullif({_norm(d, 'v')} * {_norm(d, 'q')}, 0)"
both("vec_dot", lambda d: f"SELECT vec_id, round({_dot(d)}, 6) AS dot FROM vectors, {_Q}")
both("vec_norm", lambda d: f"SELECT vec_id, round({_norm(d, 'v')}, 6) AS norm, round({d.zip_sum('v', 'v', 'CAST(x AS DOUBLE) * CAST(y AS DOUBLE)')} / power({_norm(d, 'v')}, 2), 6) AS unit FROM vectors")
both("vec_cosine", lambda d: f"SELECT vec_id, round(coalesce({cosine(d)}, 0), 6) AS cosine FROM vectors, {_Q}")
both("vec_euclid", lambda d: f"SELECT vec_id, round(sqrt({d.zip_sum('v', 'q', '(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))')}), 6) AS distance FROM vectors, {_Q}")
both("vec_manhattan", lambda d: f"SELECT vec_id, round({d.zip_sum('v', 'q', 'abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))')}, 6) AS distance FROM vectors, {_Q}")
both("vec_cosine_distance", lambda d: f"SELECT vec_id, round(coalesce(1 - greatest(-1e0, least(1e0, {cosine(d)})), 1.0), 6) AS distance FROM vectors, {_Q}")
both("vec_validate", lambda d: f"SELECT vec_id, {d.size('v')} = 64 AS right_size, {d.size(d.keep('v', 'x', 'abs(x) > 1e-7'))} > 0 AS meaningful FROM vectors")
both("vec_standardise", lambda d: f"SELECT vec_id, {d.size(d.slice('v', '1', '32'))} AS kept, {d.size(d.keep(d.slice('v', '33', '32'), 'x', 'x <> 0'))} > 0 AS lossy FROM vectors")
both("vec_dist_sim", lambda d: f"SELECT vec_id, round(1 / (1 + dist), 6) AS similarity, round(sqrt(greatest(2 * (1 - cos), 0)), 5) AS chord FROM (SELECT vec_id, sqrt({d.zip_sum('v', 'q', '(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))')}) AS dist, coalesce({cosine(d)}, 0) AS cos FROM vectors, {_Q}) t WHERE vec_id > 0")
both("vec_zero", lambda d: f"SELECT vec_id, {d.total(d.map('v', 'x', 'CAST(x AS DOUBLE) * 0'))} AS zero_sum FROM vectors")

# JSON and maps.
both("json_metadata", lambda d: f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k FROM events")
both("json_validate", lambda d: f"SELECT event_id, {d.rx('props', '^[{].*[}]$')} AS object, {d.json('props', 'k')} IS NOT NULL AS has_k FROM events")
both("json_extract_llm", lambda d: f"SELECT event_id, CAST({d.json(d.rx_extract('answer', '([{][^{}]*[}])'), 'k')} AS BIGINT) AS k FROM (SELECT event_id, concat('Here is the JSON: ', props, ' Anything else?') AS answer FROM events) t")
both("json_concept_count", lambda d: f"SELECT id, CASE WHEN length(text) > 10 THEN CAST(floor({d.rx_count('text', ',')} / 2.0) + 1 AS BIGINT) ELSE 0 END AS concepts FROM (SELECT id, {d.join('concepts', ',')} AS text FROM interactions) t")
both("map_path_lookup", lambda d: f"SELECT event_id, {d.json('doc', 'step.props.k')} AS value FROM (SELECT event_id, concat('{{\"step\":{{\"props\":', props, '}}}}') AS doc FROM events) t")
