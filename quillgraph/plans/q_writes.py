"""Writes: each query fills a store in the shared folder, changes it, and returns the table that is there afterwards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import typed
from ..sources.store import Store
from .registry import frame, view


def written(name: str, tables: dict[str, str], change: Callable[[Store, Callable[[str], DataFrame]], None], sql: str | Callable, result: str | None = None) -> None:
    """``tables``: what the store holds first. ``change``: gets the store and a reader of derived views. ``sql``: the table afterwards."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
        read = lambda statement: view(spark, sf_dir, statement)
        store.begin()
        for table, statement in tables.items():
            store.overwrite(table, read(statement))
        store.commit()
        change(store, read)
        return store.read(result or next(iter(tables)))

    frame(name, build, sql if callable(sql) else lambda d: sql)


TRIPLES = {"triples": "SELECT s, p, o FROM kg_triples"}


def _rows(store: Store, rows: list[tuple], schema: str) -> DataFrame:
    return store.spark.createDataFrame(rows, schema)


written(
    "dml_insert", TRIPLES,
    lambda s, read: s.append("triples", _rows(s, [("nation/99", "rdf:type", "Nation"), ("nation/99", "rdfs:label", "ATLANTIS")], "s string, p string, o string")),
    "SELECT s, p, o FROM kg_triples UNION ALL SELECT 'nation/99', 'rdf:type', 'Nation' UNION ALL SELECT 'nation/99', 'rdfs:label', 'ATLANTIS'",
)
written(
    "dml_delete_where", TRIPLES,
    lambda s, read: s.delete("triples", read("SELECT DISTINCT uri AS s FROM kg_nodes WHERE type = 'Part'"), "s"),
    "SELECT t.s, t.p, t.o FROM kg_triples t LEFT JOIN (SELECT DISTINCT s FROM kg_triples WHERE p = 'rdf:type' AND o = 'Part') x ON x.s = t.s WHERE x.s IS NULL",
)
written(
    "dml_phantoms", TRIPLES,
    lambda s, read: s.delete("triples", read("SELECT uri AS s FROM kg_nodes").join(read("SELECT DISTINCT src AS s FROM kg_edges"), "s", "left_anti"), "s"),
    "SELECT t.s, t.p, t.o FROM kg_triples t JOIN (SELECT DISTINCT s FROM kg_triples WHERE p <> 'rdf:type' AND p <> 'rdfs:label') x ON x.s = t.s",
)
written(
    "dml_upsert", {"scores": "SELECT doc_id, CAST(max(quality) AS DOUBLE) AS score FROM labels GROUP BY doc_id"},
    lambda s, read: s.upsert("scores", read("SELECT doc_id, CAST(doc_id AS DOUBLE) / 10 AS score FROM documents WHERE doc_id % 9 = 0"), "doc_id"),
    "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.score, CAST(o.quality AS DOUBLE)) AS score FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) o FULL OUTER JOIN (SELECT doc_id, CAST(doc_id AS DOUBLE) / 10 AS score FROM documents WHERE doc_id % 9 = 0) n ON n.doc_id = o.doc_id",
)


def _cascade(s: Store, read) -> None:
    toxic = read("SELECT DISTINCT doc_id FROM labels WHERE toxic = 1")
    s.begin()
    s.delete("documents", toxic, "doc_id")
    s.delete("mentions", toxic, "doc_id")
    s.overwrite("left", s.read("documents").select(F.lit("document").alias("kind")).unionAll(s.read("mentions").select(F.lit("mention"))).groupBy("kind").agg(F.count("*").alias("n")))
    s.commit()


written(
    "dml_cascade_delete", {"documents": "SELECT doc_id FROM documents", "mentions": "SELECT doc_id, entity FROM mentions"}, _cascade,
    "WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT 'document' AS kind, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id WHERE g.doc_id IS NULL UNION ALL SELECT 'mention', count(*) FROM mentions m LEFT JOIN gone g ON g.doc_id = m.doc_id WHERE g.doc_id IS NULL",
    result="left",
)
written(
    "dml_mark", {"documents": "SELECT doc_id, false AS processed FROM documents"},
    lambda s, read: s.upsert("documents", read("SELECT DISTINCT l.doc_id, true AS processed FROM labels l JOIN documents d ON d.doc_id = l.doc_id"), "doc_id"),
    "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS processed FROM documents",
)
written(
    "dml_prune_edges", {"edges": "SELECT src, dst, type FROM kg_edges"},
    lambda s, read: s.delete("edges", s.read("edges").groupBy("dst").count().where("count > 100"), "dst"),
    "SELECT e.src, e.dst, e.type FROM kg_edges e LEFT JOIN (SELECT dst FROM kg_edges GROUP BY dst HAVING count(*) > 100) h ON e.dst = h.dst WHERE h.dst IS NULL",
)
written(
    "dml_expire_sessions", {"views": "SELECT view, session FROM nav_views"},
    lambda s, read: s.delete("views", read("SELECT session FROM nav_views GROUP BY session HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'"), "session"),
    "SELECT v.view, v.session FROM nav_views v JOIN (SELECT session FROM nav_views GROUP BY session HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00') s ON v.session = s.session",
)


def _clear_drop_copy(s: Store, read) -> None:
    s.copy("triples", "copy")
    s.overwrite("cleared", s.read("triples").limit(0))
    s.drop("triples")
    assert "triples" not in s.tables()
    s.overwrite("left", s.read("copy").select(F.lit("copy").alias("graph")).unionAll(s.read("cleared").select(F.lit("cleared"))).groupBy("graph").agg(F.count("*").alias("n")))


written("dml_clear_drop_copy", TRIPLES, _clear_drop_copy, "SELECT 'copy' AS graph, CAST(count(*) AS BIGINT) AS n FROM kg_triples", result="left")
written(
    "dml_purge_bad_vectors", {"vectors": "SELECT vec_id, label, v FROM vectors"},
    lambda s, read: (s.delete("vectors", s.read("vectors").where("size(v) <> 64"), "vec_id"), s.overwrite("kept", s.read("vectors").select("vec_id", "label"))),
    lambda d: f"SELECT vec_id, label FROM vectors WHERE {d.size('v')} = 64", result="kept",
)
written(
    "dml_forget", {"memories": "SELECT id, importance AS relevance FROM memories"},
    lambda s, read: s.upsert("memories", read("SELECT id, importance * 0.1 AS relevance FROM memories WHERE array_contains(domains, 'project:2')"), "id"),
    lambda d: f"SELECT id, CASE WHEN {d.has('domains', "'project:2'")} THEN importance * 0.1 ELSE importance END AS relevance FROM memories",
)
written(
    "dml_switch_domain", {"views": "SELECT session, view, pan AS old_pan, pan AS new_pan, false AS faded FROM nav_views WHERE zoom = 'entity'"},
    lambda s, read: s.upsert("views", s.read("views").where("old_pan = 'domain:1'").withColumns({"new_pan": F.lit("domain:3"), "faded": F.lit(True)}), "view"),
    "SELECT session, view, pan AS old_pan, CASE WHEN pan = 'domain:1' THEN 'domain:3' ELSE pan END AS new_pan, pan = 'domain:1' AS faded FROM nav_views WHERE zoom = 'entity'",
)


def _interrupted(s: Store, read) -> None:
    s.begin()
    s.delete("triples", s.read("triples"), "s")
    s.rollback()
    s.begin()
    s.append("triples", read("SELECT concat('memory/', id) AS s, 'rdf:type' AS p, 'Interaction' AS o FROM interactions"))
    s.commit()


written("txn_rollback_commit", TRIPLES, _interrupted, "SELECT s, p, o FROM kg_triples UNION ALL SELECT concat('memory/', id), 'rdf:type', 'Interaction' FROM interactions")
written(
    "save_history", {"history": "SELECT id, prompt, output, 'short' AS kind FROM interactions WHERE access_count < 10"},
    lambda s, read: s.append("history", read("SELECT id, prompt, output, 'long' AS kind FROM interactions WHERE access_count >= 10")),
    "SELECT id, prompt, output, CASE WHEN access_count < 10 THEN 'short' ELSE 'long' END AS kind FROM interactions",
)
written(
    "store_interaction", {"interactions": "SELECT id, prompt, output FROM interactions"},
    lambda s, read: s.append("interactions", _rows(s, [("new-1", "a prompt", "its answer")], "id string, prompt string, output string")),
    "SELECT id, prompt, output FROM interactions UNION ALL SELECT 'new-1', 'a prompt', 'its answer'",
)
written(
    "batch_insert", {"elements": "SELECT uri, type, label FROM elements WHERE type = 'Entity'"},
    lambda s, read: [s.append("elements", read(f"SELECT uri, type, label FROM elements WHERE type = '{t}'")) for t in ("Unit", "TextElement", "CommunityElement", "Attribute")],
    "SELECT uri, type, label FROM elements",
)


def _typed(store: Store, read: Callable[[str], DataFrame]) -> None:
    """Nations as entities, benchmark items as units, places' relationships, regions as communities, brands as concepts."""
    typed.store_entities(store, read("SELECT uri AS id, label, 'Nation' AS sub_type, freq AS frequency, map('code', uri) AS metadata FROM kg_nodes WHERE type = 'Nation'"))
    typed.store_units(store, read("SELECT concat('item/', b.item_id) AS id, b.text AS content, m.entities FROM benchmark b LEFT JOIN (SELECT doc_id, array_sort(collect_set(entity)) AS entities FROM mentions GROUP BY doc_id) m ON m.doc_id = b.item_id"))
    typed.store_relationships(store, read("SELECT concat(src, '>', dst) AS id, src AS source, dst AS target, type, type AS label FROM kg_edges WHERE type IN ('inRegion', 'basedIn')"))
    typed.store_communities(store, read("SELECT dst AS id, dst AS label, array_sort(collect_set(src)) AS members FROM kg_edges WHERE type = 'inRegion' GROUP BY dst"))
    typed.store_concepts(store, read("SELECT DISTINCT concat('concept/', concept) AS id, concept AS label, CAST(NULL AS STRING) AS category, 'corpus/orders' AS source FROM concepts"))


def _typed_sql(d) -> str:
    each = lambda source, id_, *pairs: [f"SELECT {id_} AS s, '{p}' AS p, {o} AS o FROM {source}" for p, o in pairs]
    nation, edge = "kg_nodes WHERE type = 'Nation'", "kg_edges WHERE type IN ('inRegion', 'basedIn')"
    brand, item, region = "(SELECT DISTINCT concept FROM concepts) c", "benchmark", "(SELECT dst, count(DISTINCT src) AS n FROM kg_edges WHERE type = 'inRegion' GROUP BY dst) r"
    parts = each(nation, "uri", ("rdf:type", "'Entity'"), ("rdfs:label", "label"), ("skos:prefLabel", "label"), ("quill:subType", "'Nation'"), ("quill:frequency", "CAST(freq AS VARCHAR)"), ("quill:centrality", "'0.0'"), ("quill:isEntryPoint", "'false'"), ("quill:code", "uri"))
    parts += each(item, "concat('item/', item_id)", ("rdf:type", "'SemanticUnit'"), ("quill:content", "coalesce(text, '')"), ("quill:tokenCount", "'0'"))
    parts += each("benchmark WHERE text IS NOT NULL", "concat('item/', item_id)", ("rdfs:label", "substring(text, 1, 100)"))
    parts += ["SELECT DISTINCT concat('item/', b.item_id), 'quill:relatedTo', m.entity FROM benchmark b JOIN mentions m ON m.doc_id = b.item_id"]
    parts += each(edge, "concat(src, '>', dst)", ("rdf:type", "'Relationship'"), ("rdfs:label", "type"), ("quill:source", "src"), ("quill:target", "dst"), ("rdf:type", "type"), ("quill:weight", "'1.0'"), ("quill:confidence", "'1.0'"))
    parts += each(region, "dst", ("rdf:type", "'Community'"), ("rdfs:label", "dst"), ("quill:size", "CAST(n AS VARCHAR)")) + ["SELECT DISTINCT dst, 'quill:hasMember', src FROM kg_edges WHERE type = 'inRegion'"]
    parts += each(brand, "concat('concept/', concept)", ("rdf:type", "'Concept'"), ("rdfs:label", "concept"), ("quill:frequency", "'1'"), ("quill:category", "'general'"), ("quill:extractedFrom", "'corpus/orders'"))
    parts += [f"SELECT 'corpus/orders', 'quill:hasConcept', concat('concept/', concept) FROM {brand}"]
    return f"SELECT s, p, o FROM ({' UNION ALL '.join(parts)}) t"


written("store_typed", {"triples": "SELECT s, p, o FROM kg_triples WHERE p = 'none'"}, _typed, _typed_sql)
