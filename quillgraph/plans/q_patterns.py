"""Graph patterns over all triples: selections, questions, constructions and updates.

Each query is said twice: as patterns over the triples, and as SQL over the tables that the triples come from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.patterns import Graph, P
from .registry import frame, view


def pattern(name: str, build: Callable[[Graph], DataFrame], sql: Callable) -> None:
    frame(f"pattern_{name}", lambda spark, sf: build(Graph(view(spark, sf, "facts"))), sql)


UP = P("basedIn") | P("inRegion") | P("livesIn")
_joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")

# Selections with optional parts.
pattern(
    "articles",
    lambda g: g.match(("?uri", "rdf:type", "TextElement"), ("?uri", "rdfs:label", "?label"))
    .optional(("?uri", "dc:language", "?lang")).optional(("?uri", "dc:modified", "?modified")).optional(("?uri", "quill:quality", "?quality")).optional(("?uri", "dc:source", "?source"))
    .filter("contains(lower(label), 'e')").frame.orderBy("uri").limit(60),
    lambda d: f"SELECT uri, label, lang, CAST({d.seconds('modified')} AS VARCHAR) AS modified, CAST(quality AS VARCHAR) AS quality, source FROM (SELECT * FROM elements WHERE type = 'TextElement' AND contains(lower(label), 'e') ORDER BY uri LIMIT 60) e",
)
pattern(
    "relationships",
    lambda g: g.match(("?one", "suppliedBy", "?other")).optional(("?one", "rdfs:label", "?one_label")).optional(("?other", "rdfs:label", "?other_label")).frame,
    lambda d: "SELECT e.src AS one, e.dst AS other, a.label AS one_label, b.label AS other_label FROM kg_edges e LEFT JOIN kg_nodes a ON a.uri = e.src LEFT JOIN kg_nodes b ON b.uri = e.dst WHERE e.type = 'suppliedBy'",
)
pattern(
    "optional_chain",
    lambda g: g.match(("?place", "rdf:type", "Nation")).optional(("?who", "basedIn", "?place")).optional(("?what", "suppliedBy", "?who"), ("?what", "rdfs:label", "?label"), where="length(label) > 30").group("place", who=F.count_distinct("who"), what=F.count("what")).frame,
    lambda d: "SELECT n.uri AS place, count(DISTINCT b.src) AS who, count(x.src) AS what FROM kg_nodes n LEFT JOIN kg_edges b ON b.dst = n.uri AND b.type = 'basedIn' LEFT JOIN (SELECT e.src, e.dst FROM kg_edges e JOIN kg_nodes p ON p.uri = e.src WHERE e.type = 'suppliedBy' AND length(p.label) > 30) x ON x.dst = b.src WHERE n.type = 'Nation' GROUP BY n.uri",
)
pattern(
    "entity_content",
    lambda g: g.match(("?doc", "quill:mentions", "?entity"), ("?entity", "rdf:type", "Supplier"), ("?entity", "basedIn", "?place")).optional(("?doc", "dc:language", "?lang")).filter("entity <> 'supplier/1'").select("doc", "entity", "place", "lang"),
    lambda d: "SELECT concat('doc/', m.doc_id) AS doc, m.entity, e.dst AS place, d.lang FROM mentions m JOIN kg_nodes n ON n.uri = m.entity AND n.type = 'Supplier' JOIN kg_edges e ON e.src = m.entity AND e.type = 'basedIn' LEFT JOIN documents d ON d.doc_id = m.doc_id WHERE m.entity <> 'supplier/1'",
)

# Exclusions, alternatives and questions.
pattern(
    "unprocessed",
    lambda g: g.match(("?uri", "rdf:type", "Unit"), ("?uri", "rdfs:label", "?label")).minus(("?uri", "quill:quality", "?quality")).frame,
    lambda d: "SELECT uri, label FROM elements WHERE type = 'Unit' AND quality IS NULL AND label IS NOT NULL",
)
pattern(
    "never_read",
    lambda g: g.match(("?uri", "rdf:type", "TextElement"), ("?uri", "dc:created", "?created")).not_exists(("?uri", "quill:accessCount", "?n")).bind("created", F.col("created").cast("long")).frame,
    lambda d: f"SELECT uri, {d.seconds('created')} AS created FROM elements WHERE type = 'TextElement' AND access_count IS NULL",
)
pattern(
    "unmentioned",
    lambda g: g.match(("?uri", "rdf:type", "Supplier")).bind("kind", F.lit("supplier")).union(g.match(("?uri", "rdf:type", "Nation")).bind("kind", F.lit("nation")), g.match(("?uri", "rdf:type", "Region")).bind("kind", F.lit("region"))).minus(("?doc", "quill:mentions", "?uri")).frame,
    lambda d: "SELECT uri, lower(type) AS kind FROM kg_nodes WHERE type IN ('Supplier', 'Nation', 'Region') AND uri NOT IN (SELECT entity FROM mentions)",
)
pattern(
    "edges_of_kinds",
    lambda g: g.match(("?a", "basedIn", "?b")).bind("kind", F.lit("place")).union(g.match(("?a", "inRegion", "?b")).bind("kind", F.lit("place")), g.match(("?a", "quill:mentions", "?b")).bind("kind", F.lit("text"))).optional(("?b", "rdfs:label", "?label")).frame,
    lambda d: "SELECT a, b, kind, n.label FROM (SELECT src AS a, dst AS b, 'place' AS kind FROM kg_edges WHERE type IN ('basedIn', 'inRegion') UNION ALL SELECT concat('doc/', doc_id), entity, 'text' FROM mentions) x LEFT JOIN kg_nodes n ON n.uri = x.b",
)
pattern("document_exists", lambda g: g.match(("doc/7", "rdf:type", "?type")).ask(), lambda d: "SELECT count(*) > 0 AS found FROM elements WHERE doc_id = 7")
pattern("concept_in_conversation", lambda g: g.match(("?i", "quill:concept", "topic99"), ("?i", "quill:partOf", "?c")).ask(), lambda d: f"SELECT count(*) > 0 AS found FROM interactions WHERE {d.has('concepts', chr(39) + 'topic99' + chr(39))}")

# Groups.
pattern("count_by_type", lambda g: g.match(("?x", "rdf:type", "?type")).group("type", n=F.count("*")).frame, lambda d: "SELECT type, count(*) AS n FROM (SELECT type FROM kg_nodes UNION ALL SELECT type FROM elements UNION ALL SELECT 'Interaction' FROM interactions) x GROUP BY type")
pattern(
    "concept_use",
    lambda g: g.match(("?i", "quill:concept", "?concept"), ("?i", "quill:partOf", "?c")).group("concept", uses=F.count("*"), conversations=F.count_distinct("c"), first=F.min("c"), several=_joined(F.substring("c", 1, 14))).filter("uses > 1").frame,
    lambda d: f"SELECT concept, count(*) AS uses, count(DISTINCT conv) AS conversations, min(conv) AS first, {d.words_joined('substring(conv, 1, 14)', ',')} AS several FROM (SELECT concept, concat('conversation/', conv_id) AS conv FROM interactions{d.explode('concepts', 'concept')}) x GROUP BY concept HAVING count(*) > 1",
)
pattern(
    "statistics",
    lambda g: g.match(("?uri", "rdf:type", "?type")).filter("type in ('Entity', 'Unit', 'TextElement')").optional(("?uri", "dc:modified", "?m")).optional(("?uri", "quill:accessCount", "?a")).optional(("?uri", "quill:quality", "?q"))
    .group("type", n=F.count_distinct("uri"), modified=F.count("m"), read=F.count("a"), labelled=F.count("q")).frame,
    lambda d: "SELECT type, count(*) AS n, count(modified) AS modified, count(access_count) AS read, count(quality) AS labelled FROM elements WHERE type IN ('Entity', 'Unit', 'TextElement') GROUP BY type",
)
pattern(
    "alike",
    lambda g: g.match(("supplier/3", "?p", "?o"), ("?other", "?p", "?o")).exists(("?other", "rdf:type", "Supplier")).filter("other <> 'supplier/3'").group("other", shared=F.count_distinct("p")).frame,
    lambda d: "SELECT s AS other, count(*) AS shared FROM (SELECT DISTINCT b.s, b.p FROM kg_triples a JOIN kg_triples b ON a.p = b.p AND a.o = b.o WHERE a.s = 'supplier/3' AND b.s LIKE 'supplier/%' AND b.s <> 'supplier/3') x GROUP BY s",
)

# Paths.
pattern(
    "traverse",
    lambda g: g.match(("part/1", P("suppliedBy").maybe() / UP.times(0, 2), "?goal")).optional(("?goal", "rdfs:label", "?label")).group("goal", "label", ways=F.count("*")).frame,
    lambda d: "WITH base AS (SELECT 'part/1' AS x UNION SELECT dst FROM kg_edges WHERE src = 'part/1' AND type = 'suppliedBy'), up AS (SELECT src, dst FROM kg_edges WHERE type IN ('basedIn', 'inRegion', 'livesIn')), far AS (SELECT x, x AS goal FROM base UNION SELECT x, dst FROM base JOIN up ON src = x UNION SELECT x, b.dst FROM base JOIN up a ON a.src = x JOIN up b ON b.src = a.dst) SELECT goal, label, count(*) AS ways FROM far LEFT JOIN kg_nodes n ON n.uri = far.goal GROUP BY goal, label",
)
pattern(
    "mentioned_regions",
    lambda g: g.match(("?doc", P("quill:mentions") / UP.star(), "?region"), ("?region", "rdf:type", "Region")).group("region", docs=F.count_distinct("doc")).frame,
    lambda d: "WITH located AS (SELECT m.doc_id, CASE WHEN m.entity LIKE 'nation/%' THEN m.entity ELSE e.dst END AS nation FROM mentions m LEFT JOIN kg_edges e ON e.src = m.entity AND e.type = 'basedIn') SELECT r.dst AS region, count(DISTINCT doc_id) AS docs FROM located JOIN kg_edges r ON r.src = located.nation AND r.type = 'inRegion' GROUP BY r.dst",
)
pattern(
    "siblings",
    lambda g: g.match(("?a", P("inRegion") / ~P("inRegion"), "?b")).filter("a < b").select("a", "b"),
    lambda d: "SELECT x.src AS a, y.src AS b FROM kg_edges x JOIN kg_edges y ON x.dst = y.dst AND x.src < y.src WHERE x.type = 'inRegion' AND y.type = 'inRegion'",
)
pattern(
    "instances_below",
    lambda g: g.match(("?x", "rdf:type", "Customer"), ("?x", UP.plus(), "region/2"), ("?x", "rdfs:label", "?label")).select("x", "label"),
    lambda d: "SELECT c.uri AS x, c.label FROM kg_nodes c JOIN kg_edges a ON a.src = c.uri AND a.type = 'livesIn' JOIN kg_edges b ON b.src = a.dst AND b.type = 'inRegion' AND b.dst = 'region/2' WHERE c.type = 'Customer'",
)

# Constructions.
pattern(
    "construct_entities",
    lambda g: g.match(("?x", "rdf:type", "?type"), ("?x", "rdfs:label", "?label")).filter("type in ('Nation', 'Region', 'Supplier')").optional(("?x", "basedIn", "?place"))
    .construct(("?x", "skos:prefLabel", "?label"), ("?x", "quill:kind", "?type"), ("?x", "quill:place", "?place")),
    lambda d: "SELECT uri AS s, 'skos:prefLabel' AS p, label AS o FROM kg_nodes WHERE type IN ('Nation', 'Region', 'Supplier') UNION SELECT uri, 'quill:kind', type FROM kg_nodes WHERE type IN ('Nation', 'Region', 'Supplier') UNION SELECT src, 'quill:place', dst FROM kg_edges WHERE type = 'basedIn'",
)
pattern(
    "construct_domains",
    lambda g: g.match(("?doc", "dc:source", "?source"), ("?doc", "quill:mentions", "?e")).group("source", "e", n=F.count("*")).filter("n > 1").bind("domain", F.concat(F.lit("domain/"), "source")).construct(("?domain", "quill:covers", "?e"), ("?domain", "rdf:type", "Domain")),
    lambda d: "WITH x AS (SELECT d.source, m.entity FROM documents d JOIN mentions m ON m.doc_id = d.doc_id WHERE d.source IS NOT NULL GROUP BY d.source, m.entity HAVING count(*) > 1) SELECT concat('domain/', source) AS s, 'quill:covers' AS p, entity AS o FROM x UNION SELECT concat('domain/', source), 'rdf:type', 'Domain' FROM x",
)

# Updates: the graph afterwards.
_WHOLE = "SELECT DISTINCT s, p, o FROM facts"
pattern(
    "delete_phantoms",
    lambda g: g.update(g.match(("?doc", "quill:mentions", "?x")).not_exists(("?x", "rdf:type", "?type")), delete=[("?doc", "quill:mentions", "?x")]),
    lambda d: f"{_WHOLE} WHERE NOT (p = 'quill:mentions' AND o NOT IN (SELECT uri FROM kg_nodes))",
)
pattern("delete_elements", lambda g: g.update(g.match(("?x", "rdf:type", "Attribute"), ("?x", "?p", "?o")), delete=[("?x", "?p", "?o")]), lambda d: f"{_WHOLE} WHERE s NOT IN (SELECT uri FROM elements WHERE type = 'Attribute')")
pattern(
    "replace_status",
    lambda g: g.update(g.match(("?x", "rdf:type", "Unit"), ("?x", "quill:quality", "?q")), delete=[("?x", "quill:quality", "?q")], insert=[("?x", "quill:wasQuality", "?q"), ("?x", "quill:status", "processed")]),
    lambda d: f"WITH u AS (SELECT uri, concat('', quality) AS q FROM elements WHERE type = 'Unit' AND quality IS NOT NULL) {_WHOLE} WHERE NOT (p = 'quill:quality' AND s IN (SELECT uri FROM u)) UNION SELECT uri, 'quill:wasQuality', q FROM u UNION SELECT uri, 'quill:status', 'processed' FROM u",
)
pattern(
    "insert_data",
    lambda g: Graph(g.insert_data([("nation/1", "rdf:type", "Nation"), ("note/1", "rdf:type", "Note"), ("note/1", "quill:mentions", "nation/1")])).match(("?s", "?p", "?o")).filter("s in ('nation/1', 'note/1')").select("s", "p", "o"),
    lambda d: "SELECT s, p, o FROM kg_triples WHERE s = 'nation/1' UNION SELECT 'note/1', 'rdf:type', 'Note' UNION SELECT 'note/1', 'quill:mentions', 'nation/1'",
)
