"""Navigation as one plan: zoom picks the level, pan filters, tilt ranks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZOOMS = ("micro", "entity", "text", "unit", "community", "corpus")
TILTS = ("keywords", "embedding", "graph", "temporal", "frequency")
#: Tokens that one result takes, by level (fixed values).
TOKENS = {"micro": 10, "entity": 50, "unit": 200, "text": 500, "community": 800, "corpus": 2000}


@dataclass
class Pan:
    keywords: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    box: tuple[float, float, float, float] | None = None

    def filters(self, columns: list[str]) -> list[Column]:
        """Conditions on those of label, uri, domain, at, lat, lon that the level has. A level without a time keeps all."""
        out = []
        if self.keywords and "label" in columns:
            out.append(reduce(lambda a, b: a | b, [F.lower("label").contains(k.lower()) for k in self.keywords]))
        if self.entities and "uri" in columns:
            out.append(F.col("uri").isin(self.entities))
        if self.domains and "domain" in columns:
            out.append(F.col("domain").isin(self.domains))
        if "at" in columns:
            if self.since:
                out.append(F.col("at").isNull() | (F.col("at") >= F.lit(self.since).cast("timestamp")))
            if self.until:
                out.append(F.col("at").isNull() | (F.col("at") <= F.lit(self.until).cast("timestamp")))
        if self.box and {"lat", "lon"} <= set(columns):
            south, west, north, east = self.box
            out += [F.col("lat").between(south, north), F.col("lon").between(west, east)]
        return out


@dataclass
class Spec:
    zoom: str = "entity"
    tilt: str = "keywords"
    pan: Pan = field(default_factory=Pan)
    limit: int | None = None
    token_budget: int = 4000

    def check(self) -> None:
        if self.zoom not in ZOOMS:
            raise ValueError(f"zoom is one of {ZOOMS}")
        if self.tilt not in TILTS:
            raise ValueError(f"tilt is one of {TILTS}")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit is at least 1")

    def rows(self) -> int:
        """The limit, or what the token budget has room for."""
        return self.limit or max(1, min(int(self.token_budget * 0.8 / TOKENS[self.zoom]), 1000))


def navigate(levels: dict[str, DataFrame], spec: Spec, *, score: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The best rows of a level. ``levels``: uri, label and, as there are, score, freq, at, domain, lat, lon, by zoom."""
    spec.check()
    df = levels[spec.zoom]
    for condition in spec.pan.filters(df.columns):
        df = df.where(condition)
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    words = [k.lower() for k in spec.pan.keywords]
    by = {
        "keywords": reduce(lambda a, b: a + b, [F.regexp_count(F.lower("label"), F.lit(k)).cast("double") for k in words], F.lit(0.0)) if "label" in df.columns else F.lit(0.0),
        "embedding": has("score", 0.0),
        "graph": has("freq", 0).cast("double"),
        "frequency": has("freq", 0).cast("double"),
        "temporal": F.unix_timestamp("at").cast("double") if "at" in df.columns else F.lit(0.0),
    }[spec.tilt]
    return df.withColumn("rank_score", score(df) if score else by).orderBy(F.desc_nulls_last("rank_score"), "uri").limit(spec.rows())


def selectivity(spec: Spec) -> float:
    """The share of rows that the filters are expected to keep: fixed factors, multiplied."""
    p = spec.pan
    factors = [0.3 if p.keywords else 1, 0.1 if p.entities else 1, 0.4 if p.domains else 1, 0.5 if p.since or p.until else 1, 0.2 if p.box else 1]
    return max(0.001, reduce(lambda a, b: a * b, factors))


def complexity(spec: Spec) -> int:
    p = spec.pan
    level = {"micro": 5, "entity": 4, "unit": 3, "text": 2}.get(spec.zoom, 1)
    return min(10, level + len(p.keywords) + len(p.entities) + len(p.domains) + bool(p.since or p.until) + bool(p.box) + (2 if spec.tilt in ("embedding", "graph") else 1))
