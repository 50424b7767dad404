"""Queries against their SQL on rows that the test tables lack."""

import duckdb
import pandas as pd

from quillgraph.plans import registry


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over these tables."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.to_parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, str(folder)), con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    return sorted(map(tuple, ours.select(*columns).collect()), key=str), sorted(theirs.fetchall(), key=str)


def test_an_empty_text_has_no_chunks(spark, tmp_path):
    texts = ["", None, " ", "a" * 900, "b" * 901, "c" * 1000, "d" * 1801, "\U0001f926\U0001f3fc‍♂️" * 400]
    ours, theirs = both(spark, tmp_path, "chunk_fixed", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert ours == theirs and {r[0] for r in ours} == set(range(2, len(texts)))


def test_a_deviation_on_the_threshold_rounds_as_in_sql(spark, tmp_path):
    """Of two values 40 apart the deviation is 20, or next to it, by the order of its steps."""
    rows = [(u, k, v) for u in range(3000) for k, v in enumerate((round(u * 0.37, 2), round(u * 0.37 + 40, 2), None, round(u * 0.11, 2)))]
    events = pd.DataFrame([(i, u, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=k), v) for i, (u, k, v) in enumerate(rows)], columns=["event_id", "user_id", "ts", "value"])
    events = events.astype({"value": "float64", "ts": "datetime64[us]"})
    ours, theirs = both(spark, tmp_path, "win_convergence", events=events)
    assert ours == theirs and len({c for _, c in ours}) == 2
