"""A Python data source for lookups in outside knowledge, with a table in the place of the network.

``LookupSource`` is registered as ``lookup``; a subclass may override ``fetch`` to call a service for one term. Terms are
partitions, so calls run side by side on executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Term(InputPartition):
    def __init__(self, term: str):
        self.term = term


class _Reader(DataSourceReader):
    def __init__(self, source: LookupSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [_Term(t) for t in self.source.options.get("terms", "").split("|") if t]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for title, snippet, score in self.source.fetch(partition.term):
            yield (partition.term, title, snippet, score)


class LookupSource(DataSource):
    """Options: terms (joined by |), entries (JSON object of title to text)."""

    @classmethod
    def name(cls) -> str:
        return "lookup"

    def schema(self) -> str:
        return "term string, title string, snippet string, score double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)

    def fetch(self, term: str) -> Iterator[tuple[str, str, float]]:
        import json

        low = term.lower()
        for title, text in json.loads(self.options.get("entries", "{}")).items():
            if low in title.lower() or low in text.lower():
                yield title, text[:200], 1.0 if title.lower() == low else 0.8 if low in title.lower() else 0.4


def register(spark) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(LookupSource)
