"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillgraph.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if hasattr(v, "tolist") and not isinstance(v, str | bytes):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "-"
        if hasattr(v, "strftime"):
            return str(v)[:19].replace(" 00:00:00", "")
        if type(v).__name__ == "Decimal":
            v = float(v)
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.6g}"
        return str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_cover_their_tables(spark):
    rows = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").count()
    for name, table, power in (("str_html_entities", "pages", 1), ("str_escape", "documents", 1), ("doc_chunks", "conversations", 1), ("str_jaccard_words", "benchmark", 2)):
        assert registry.QUERIES[name](spark, DATA).count() == rows(table) ** power, name
