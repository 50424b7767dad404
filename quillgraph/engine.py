"""One object for callers: tables in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import graph, navigate, som, text, vectors
from .operators.patterns import Graph
from .operators.vector_index import VectorIndex
from .plans import registry
from .sources import files, ntriples
from .sources.store import Store


class Engine:
    """Queries over the tables in ``data``; a store for what callers add."""

    graph, text, vectors, som, files, ntriples = graph, text, vectors, som, files, ntriples

    def __init__(self, spark: SparkSession, data: str, store: str | None = None):
        self.spark, self.data = spark, data
        self.store = Store(spark, store) if store else None

    def view(self, name: str) -> DataFrame:
        """A base table or a derived one: nodes, edges, triples, elements, interactions and so on."""
        return registry.view(self.spark, self.data, name)

    def sql(self, statement: str) -> DataFrame:
        """SQL over base and derived tables."""
        return registry.view(self.spark, self.data, statement)

    def patterns(self, view: str = "facts") -> Graph:
        """The triples of a view, for graph patterns, paths, constructions and updates."""
        return Graph(self.view(view))

    def vector_index(self, path: str, vectors: DataFrame | None = None) -> VectorIndex:
        """The index in a folder; with ``vectors`` (vec_id, v, label), built from them first."""
        return VectorIndex(self.spark, path) if vectors is None else VectorIndex.build(vectors, path)

    def run(self, name: str) -> DataFrame:
        """A registered query."""
        return registry.QUERIES[name](self.spark, self.data)

    def levels(self) -> dict[str, DataFrame]:
        v = self.view
        elements = v("elements").selectExpr("uri", "type", "label", "similarity AS score", "coalesce(access_count, 0) AS freq", "coalesce(modified, created) AS at", "source AS domain")
        places = v("places").selectExpr("uri", "lat", "lon")
        entities = v("kg_nodes").join(places, "uri", "left")
        return {
            "micro": v("kg_triples").selectExpr("concat(s, '/', p) AS uri", "o AS label"),
            "entity": entities,
            "unit": elements.where("type = 'Unit'"),
            "text": elements,
            "community": v("SELECT e.dst AS uri, e.dst AS label, avg(n.score) AS score, count(*) AS freq FROM kg_edges e JOIN kg_nodes n ON n.uri = e.src GROUP BY e.dst"),
            "corpus": v("SELECT source AS uri, source AS label, avg(similarity) AS score, count(*) AS freq FROM elements GROUP BY source"),
        }

    def navigate(self, spec: navigate.Spec) -> DataFrame:
        return navigate.navigate(self.levels(), spec)
