"""The graph, memory and navigation tables that queries run on, derived once from the base tables.

Each view is a function of the dialect, so that Spark and the checking engine read the same definition. Times come from
keys, so that every result is reproducible: NOW stands for the present.
"""

from __future__ import annotations

import re

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NOW = "TIMESTAMP '2024-06-01 00:00:00'"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
DAY0 = "DATE '2024-01-01'"

VIEWS = {
    # Typed nodes and weighted edges.
    "kg_nodes": lambda d: """
        SELECT concat('region/', r_regionkey) AS uri, 'Region' AS type, r_name AS label, CAST(1.0 AS DOUBLE) AS score, CAST(5 AS BIGINT) AS freq FROM region
        UNION ALL SELECT concat('nation/', n_nationkey), 'Nation', n_name, CAST(0.9 AS DOUBLE), CAST(n_nationkey % 7 AS BIGINT) FROM nation
        UNION ALL SELECT concat('customer/', c_custkey), 'Customer', c_name, (c_acctbal + 1000) / 12000, c_custkey % 23 FROM customer
        UNION ALL SELECT concat('supplier/', s_suppkey), 'Supplier', s_name, (s_acctbal + 1000) / 12000, s_suppkey % 19 FROM supplier
        UNION ALL SELECT concat('part/', p_partkey), 'Part', p_name, p_retailprice / 2500, p_partkey % 31 FROM part""",
    "kg_edges": lambda d: """
        SELECT concat('nation/', n_nationkey) AS src, concat('region/', n_regionkey) AS dst, 'inRegion' AS type, CAST(1.0 AS DOUBLE) AS weight FROM nation
        UNION ALL SELECT concat('customer/', c_custkey), concat('nation/', c_nationkey), 'livesIn', CAST(1.0 AS DOUBLE) FROM customer
        UNION ALL SELECT concat('supplier/', s_suppkey), concat('nation/', s_nationkey), 'basedIn', CAST(1.0 AS DOUBLE) FROM supplier
        UNION ALL SELECT concat('part/', l_partkey), concat('supplier/', l_suppkey), 'suppliedBy', sum(l_quantity) FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "kg_adj": lambda d: """SELECT src AS a, dst AS b FROM kg_edges WHERE src <> dst UNION SELECT dst, src FROM kg_edges WHERE src <> dst""",
    "kg_triples": lambda d: """
        SELECT uri AS s, 'rdf:type' AS p, type AS o FROM kg_nodes UNION ALL SELECT uri, 'rdfs:label', label FROM kg_nodes UNION ALL SELECT src, type, dst FROM kg_edges""",
    # Everything as triples: the graph, text elements with what is known of them, and interactions.
    "facts": lambda d: f"""
        SELECT s, p, o FROM kg_triples
        UNION ALL SELECT uri, 'rdf:type', type FROM elements
        UNION ALL SELECT uri, 'rdfs:label', label FROM elements WHERE label IS NOT NULL
        UNION ALL SELECT uri, 'dc:source', source FROM elements WHERE source IS NOT NULL
        UNION ALL SELECT uri, 'dc:language', lang FROM elements WHERE lang IS NOT NULL
        UNION ALL SELECT uri, 'dc:created', concat('', {d.seconds('created')}) FROM elements
        UNION ALL SELECT uri, 'dc:modified', concat('', {d.seconds('modified')}) FROM elements WHERE modified IS NOT NULL
        UNION ALL SELECT uri, 'quill:accessCount', concat('', access_count) FROM elements WHERE access_count IS NOT NULL
        UNION ALL SELECT uri, 'quill:quality', concat('', quality) FROM elements WHERE quality IS NOT NULL
        UNION ALL SELECT concat('doc/', doc_id), 'quill:mentions', entity FROM mentions
        UNION ALL SELECT concat('interaction/', id), 'rdf:type', 'Interaction' FROM interactions
        UNION ALL SELECT concat('interaction/', id), 'quill:partOf', concat('conversation/', conv_id) FROM interactions
        UNION ALL SELECT concat('interaction/', id), 'quill:concept', c FROM interactions{d.explode('concepts', 'c')}""",
    # Text elements with the optional properties that ranking looks at.
    "elements": lambda d: f"""
        SELECT concat('doc/', d.doc_id) AS uri, d.doc_id, {d.at(d.array("'Entity'", "'Unit'", "'TextElement'", "'CommunityElement'", "'Attribute'"), 'CAST(d.doc_id % 5 + 1 AS INT)')} AS type,
          substring(d.text, 1, 40) AS label, d.text AS content, d.source, d.lang, {d.length('d.text')} AS chars,
          {d.plus_seconds(EPOCH, 'd.doc_id * 7919 % 10000000')} AS created, CASE WHEN d.doc_id % 3 = 0 THEN {d.plus_seconds(EPOCH, 'd.doc_id * 104729 % 12000000')} END AS modified,
          CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100 AS similarity, CASE WHEN d.doc_id % 4 = 0 THEN CAST(d.doc_id % 120 AS BIGINT) END AS access_count, l.quality, l.toxic
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "mentions": lambda d: """SELECT doc_id, concat('nation/', doc_id % 25) AS entity, doc_id % 10 + 1 AS weight FROM documents UNION ALL SELECT doc_id, concat('supplier/', doc_id * 7 % 100 + 1), doc_id % 5 + 1 FROM documents""",
    "interactions": lambda d: f"""
        SELECT concat(conv_id, '-', turn) AS id, conv_id, turn, text AS prompt, answer AS output, {d.plus_seconds(EPOCH, 'conv_id * 5400 + turn * 60')} AS ts, (conv_id * 13 + turn) % 40 AS access_count,
          {d.array("concat('topic', conv_id % 11)", "concat('topic', (conv_id + turn) % 7)", "concat('lang', turn % 3)")} AS concepts
        FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) c
        WHERE role = 'user' AND next_role = 'assistant'""",
    "memories": lambda d: f"""
        SELECT event_id AS id, user_id, ts, {d.plus_seconds('ts', 'event_id * 977 % 4000000')} AS last_accessed, event_id % 60 AS access_count, CAST(event_id % 11 AS DOUBLE) / 10 AS importance,
          {d.array("concat(CASE user_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'project' WHEN 2 THEN 'session' ELSE 'instruction' END, ':', user_id % 3)", "concat('project:', event_id % 4)")} AS domains, value, event_type FROM events""",
    "nav_views": lambda d: f"""
        SELECT event_id AS view, concat('s', user_id) AS session, {d.at(d.array("'entity'", "'unit'", "'text'", "'community'", "'corpus'", "'micro'"), 'CAST(event_id % 6 + 1 AS INT)')} AS zoom,
          event_type AS tilt, ts, value AS score, concat('nation/', event_id % 25) AS corpuscle, concat('domain:', user_id % 4) AS pan FROM events""",
    "concepts": lambda d: """SELECT DISTINCT concat('order/', l.l_orderkey) AS item, p.p_brand AS concept FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "places": lambda d: """SELECT concat('nation/', n_nationkey) AS uri, n_name AS label, CAST(n_nationkey * 7 % 180 - 90 AS DOUBLE) AS lat, CAST(n_nationkey * 29 % 360 - 180 AS DOUBLE) AS lon, concat('region/', n_regionkey) AS admin FROM nation""",
    "vectors": lambda d: """SELECT vec_id, embedding AS v, label FROM embeddings""",
    # What three searches found: by vector, by words, and by what the graph links to two entities.
    "results": lambda d: """
        SELECT uri, type, content, similarity AS score, 'vector' AS origin FROM elements WHERE similarity >= 0.8
        UNION ALL SELECT uri, type, content, similarity / 2 + 0.3, 'exact' FROM elements WHERE contains(lower(label), 'in')
        UNION ALL SELECT uri, type, content, 0.9 - similarity / 3, 'graph' FROM elements WHERE doc_id IN (SELECT doc_id FROM mentions WHERE entity IN ('nation/7', 'supplier/3'))""",
}


def needed(body: str) -> list[str]:
    """Views that a query reads, those they read first."""
    out: list[str] = []

    def add(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in out and re.search(rf"\b{name}\b", text):
                from .dialect import Spark

                add(view(Spark()))
                if name not in out:
                    out.append(name)

    add(body)
    return out


def statement(body: str, d, sf_dir: str | None) -> str:
    """A whole statement: base tables (for Spark: files), derived views, then the body, which may begin with WITH."""
    views = [(name, VIEWS[name](d)) for name in needed(body)]
    text = " ".join([body, *(v for _, v in views)])
    tables = [(t, f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`") for t in BASE if sf_dir and re.search(rf"\b{t}\b", text)]
    recursive = bool(re.match(r"\s*WITH\s+RECURSIVE", body))
    own = re.match(r"\s*WITH\s+(?:RECURSIVE\s+)?", body)
    head = ", ".join(f"{name} AS ({sql})" for name, sql in tables + views)
    if not head:
        return body
    rest = body[own.end() :] if own else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (f", {rest}" if own else f" {body}")
