"""Typed inserts: entities, units, relationships, communities and concepts as triples of a store's table.

Each kind takes a DataFrame with an ``id`` and any of its columns; a column that is missing or null has its default, if
there is one, and else no triple. Arrays give a triple for each entry, maps one for each key. Rows without an id are
refused by name, as they can't be found again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from .store import Store

TABLE = "triples"
#: Of each kind its class, and of each column the property and the default.
KINDS: dict[str, tuple[str, dict[str, tuple[str, object]]]] = {
    "entity": ("Entity", {"label": ("rdfs:label", ""), "pref_label": ("skos:prefLabel", None), "sub_type": ("quill:subType", "Entity"), "frequency": ("quill:frequency", 1), "centrality": ("quill:centrality", 0.0), "is_entry_point": ("quill:isEntryPoint", False), "description": ("rdfs:comment", None), "metadata": ("quill:", None)}),
    "unit": ("SemanticUnit", {"content": ("quill:content", ""), "summary": ("rdfs:label", None), "tokens": ("quill:tokenCount", 0), "importance": ("quill:importance", None), "entities": ("quill:relatedTo", None), "part_of": ("quill:partOf", None)}),
    "relationship": ("Relationship", {"label": ("rdfs:label", ""), "source": ("quill:source", None), "target": ("quill:target", None), "type": ("rdf:type", None), "weight": ("quill:weight", 1.0), "confidence": ("quill:confidence", 1.0), "properties": ("quill:", None)}),
    "community": ("Community", {"label": ("rdfs:label", ""), "cohesion": ("quill:cohesion", None), "size": ("quill:size", None), "members": ("quill:hasMember", None), "description": ("rdfs:comment", None)}),
    "concept": ("Concept", {"label": ("rdfs:label", ""), "confidence": ("quill:confidence", None), "frequency": ("quill:frequency", 1), "category": ("quill:category", "general"), "source": ("quill:extractedFrom", None)}),
}


def _entries(column: str, p: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(p).alias("p"), x.cast("string").alias("o")))


def _keys(column: str, p: str) -> Column:
    return F.transform(F.map_entries(column), lambda e: F.struct(F.concat(F.lit(p), e.key).alias("p"), e.value.cast("string").alias("o")))


def triples(kind: str, rows: DataFrame) -> DataFrame:
    """s, p, o of the rows of one kind."""
    name, columns = KINDS[kind]
    if kind == "unit" and "content" in rows.columns:
        short = F.substring("content", 1, 100)
        rows = rows.withColumn("summary", F.coalesce("summary", short) if "summary" in rows.columns else short)
    if kind == "community" and "members" in rows.columns:
        count = F.size("members")
        rows = rows.withColumn("size", F.coalesce("size", count) if "size" in rows.columns else count)
    if kind == "entity" and "label" in rows.columns:
        rows = rows.withColumn("pref_label", F.coalesce("pref_label", "label") if "pref_label" in rows.columns else F.col("label"))
    one = lambda p, o: F.array(F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")))
    parts: list[Column] = [one("rdf:type", F.lit(name))]
    for column, (p, default) in columns.items():
        there = column in rows.columns
        field = rows.schema[column].dataType if there else None
        if isinstance(field, ArrayType):
            parts.append(_entries(column, p))
        elif isinstance(field, MapType):
            parts.append(_keys(column, p))
        elif there or default is not None:
            value = F.col(column) if there else F.lit(None)
            parts.append(one(p, F.coalesce(value.cast("string"), F.lit(None if default is None else str(default).lower() if isinstance(default, bool) else str(default)))))
    if kind == "concept" and "source" in rows.columns:  # the way back
        back = rows.select(F.col("source").alias("s"), F.lit("quill:hasConcept").alias("p"), F.col("id").alias("o")).where("s is not null and o is not null")
    else:
        back = None
    known = F.when(F.col("id").isNull(), F.raise_error(F.lit(f"a row of kind {kind} has no id"))).otherwise(F.col("id").cast("string"))
    everything = F.concat(*[F.coalesce(x, F.array().cast("array<struct<p:string,o:string>>")) for x in parts])
    out = rows.select(known.alias("s"), F.inline(everything)).where("o is not null")
    return out if back is None else out.unionByName(back)


def _storing(kind: str) -> Callable[[Store, DataFrame], None]:
    def store_rows(store: Store, rows: DataFrame) -> None:
        store.append(TABLE, triples(kind, rows))

    store_rows.__doc__ = f"Appends rows of kind {kind} to the store's table of triples."
    return store_rows


store_entities, store_units, store_relationships, store_communities, store_concepts = map(_storing, KINDS)
