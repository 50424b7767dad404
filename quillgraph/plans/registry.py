"""All registered queries and their SQL, side by side.

``both`` registers one relational expression for the two engines; ``frame`` registers a DataFrame operator with an
independently written statement, or with none where SQL cannot say it (then a test holds it against brute force).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dialect, kg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SPARK, _DUCK = dialect.Spark(), dialect.Duck()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived view or a statement over derived views, as a DataFrame."""
    body = f"SELECT * FROM {sql}" if sql in kg.VIEWS or sql in kg.BASE else sql
    return spark.sql(kg.statement(body, _SPARK, sf_dir))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals, which only literals bring in, as doubles."""
    return df.select(*[df[c].cast("double").alias(c) if t.startswith("decimal") else df[c] for c, t in df.dtypes]) if any(t.startswith("decimal") for _, t in df.dtypes) else df


def both(name: str, body: Callable[[dialect.Spark], str]) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, sf_dir: _plain(spark.sql(kg.statement(body(_SPARK), _SPARK, sf_dir)))
    ORACLE_SQL[name] = kg.statement(body(_DUCK), _DUCK, None)


def frame(name: str, build: Callable[[SparkSession, str], DataFrame], sql: Callable[[dialect.Spark], str] | None = None) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = kg.statement(sql(_DUCK), _DUCK, None)


from . import q_algorithms, q_patterns, q_relational, q_scalars, q_search, q_text, q_writes  # noqa: E402, F401
