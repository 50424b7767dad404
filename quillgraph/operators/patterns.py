"""Graph patterns over tables of triples, as joins.

A pattern is a triple whose parts are constants or variables (``"?name"``); ``Graph.match`` turns a group of them into one
equi-join per shared variable, and what comes back, ``Solutions``, has one column per variable. Optional parts, exclusions,
alternatives, property paths, construction and updates are methods of it; grouping, ordering and limits are those of its
``frame``. Everything is one lazy plan, but for closures (``plus``, ``star``): they are run to a fixpoint, each round
joining only the pairs that the round before found new.

A variable that an optional part left unbound is null. Where it is shared with a later pattern, it fits any value, as
long as another shared variable is bound; if none is, such a row has no match. Filters drop rows whose condition is null.
Patterns of one group, and the groups joined, must share variables: a product of unrelated matches is refused.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import closure

Pattern = tuple


def is_variable(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def variables(patterns: Iterable[Pattern]) -> list[str]:
    """Names of all variables, without their marks, in order."""
    return list(dict.fromkeys(x[1:] for p in patterns for x in p if is_variable(x)))


@dataclass(frozen=True)
class Path:
    """A property path: ``P("a") / P("b")``, ``P("a") | P("b")``, ``~P("a")``, ``.maybe()``, ``.plus()``, ``.star()``, ``.times(1, 3)``."""

    kind: str
    parts: tuple = ()
    name: str = ""
    least: int = 1
    most: int | None = None

    def __truediv__(self, other: Path) -> Path:
        return Path("sequence", (self, other))

    def __or__(self, other: Path) -> Path:
        return Path("either", (self, other))

    def __invert__(self) -> Path:
        return Path("inverse", (self,))

    def times(self, least: int, most: int | None) -> Path:
        return Path("times", (self,), least=least, most=most)

    def maybe(self) -> Path:
        return self.times(0, 1)

    def plus(self) -> Path:
        return self.times(1, None)

    def star(self) -> Path:
        return self.times(0, None)


def P(name: str) -> Path:  # noqa: N802
    """The path of one edge of that name."""
    return Path("edge", name=name)


def steps(triples: DataFrame, path: Path, starts: DataFrame | None = None) -> DataFrame:
    """a, b: the ends of every way along the path; with ``starts`` (a column a), of those that begin there."""
    if path.kind == "edge":
        found = triples.where(F.col("p") == path.name).select(F.col("s").alias("a"), F.col("o").alias("b"))
        return found if starts is None else found.join(starts, "a", "left_semi")
    if path.kind == "inverse":
        found = steps(triples, path.parts[0]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        return found if starts is None else found.join(starts, "a", "left_semi")
    if path.kind == "either":
        return steps(triples, path.parts[0], starts).unionByName(steps(triples, path.parts[1], starts))
    if path.kind == "sequence":
        first, second = steps(triples, path.parts[0], starts), steps(triples, path.parts[1])
        return first.toDF("a", "via").join(second.toDF("via", "b"), "via").select("a", "b")
    if starts is None:
        starts = triples.select(F.col("s").alias("a")).union(triples.select("o")).distinct() if path.least == 0 else None
    edges = steps(triples, path.parts[0]).distinct()
    far = closure(edges, starts=starts, least=path.least, most=path.most)
    return far.select("a", "b")


class Solutions:
    """Rows of variable bindings (``frame``); ``unbound``: variables that may be null."""

    def __init__(self, graph: Graph, frame: DataFrame, unbound: frozenset[str] = frozenset()):
        self.graph, self.frame, self.unbound = graph, frame, unbound

    @property
    def names(self) -> list[str]:
        return self.frame.columns

    def _with(self, frame: DataFrame, unbound: Iterable[str] = ()) -> Solutions:
        return Solutions(self.graph, frame, frozenset(unbound) & frozenset(frame.columns))

    def _parts(self, shared: list[str]) -> list[tuple[DataFrame, list[str]]]:
        """The rows by which of the shared variables they have unbound, each part with the variables to join on."""
        parts = [(self.frame, shared)]
        if any(c not in self.unbound for c in shared):
            for c in sorted(self.unbound & set(shared)):
                parts = [x for rows, keys in parts for x in ((rows.where(F.col(c).isNotNull()), keys), (rows.where(F.col(c).isNull()), [k for k in keys if k != c]))]
        return parts

    def _matched(self, found: DataFrame, how: str, where: str | Column | None = None) -> DataFrame:
        """Join with matches on all shared variables; ``where`` may look at the variables of both sides."""
        shared = [c for c in found.columns if c in self.names]
        if not shared:
            raise ValueError(f"no variable of {self.names} is in {found.columns}")
        mark = lambda c: f"{c}__found"
        right = found.select(*[F.col(c).alias(mark(c)) for c in found.columns])
        both = [(F.coalesce(c, mark(c)) if c in found.columns else F.col(c)).alias(c) for c in self.names] + [F.col(mark(c)).alias(c) for c in found.columns if c not in self.names]
        out = []
        for rows, keys in self._parts(shared):
            on = reduce(lambda x, y: x & y, [F.col(c) == F.col(mark(c)) for c in keys])
            matches = right
            if where is not None:
                seen = rows.join(right, on).select(*both, *right.columns)
                matches = seen.where(where).select(*right.columns).distinct()
            joined = rows.join(matches, on, how)
            out.append(joined.select(*(self.names if how in ("left_semi", "left_anti") else both)))
        return reduce(DataFrame.unionByName, out)

    def match(self, *patterns: Pattern) -> Solutions:
        """Rows that fit all patterns, with their variables added."""
        seeds = self if any(isinstance(p[1], Path) for p in patterns) else None
        found = self.graph.match(*patterns, seeds=seeds).frame
        return self._with(self._matched(found, "inner"), self.unbound - set(found.columns))

    def optional(self, *patterns: Pattern, where: str | Column | None = None) -> Solutions:
        """As ``match`` where something fits; other rows stay, with the new variables unbound."""
        found = self.graph.match(*patterns).frame
        return self._with(self._matched(found, "left", where), self.unbound | (set(found.columns) - set(self.names)))

    def minus(self, *patterns: Pattern) -> Solutions:
        """Rows that no match of the patterns fits; all rows if they share no variable."""
        found = self.graph.match(*patterns).frame
        shared = [c for c in found.columns if c in self.names]
        return self._with(self._matched(found.select(*shared).distinct(), "left_anti"), self.unbound) if shared else self

    def exists(self, *patterns: Pattern) -> Solutions:
        found = self.graph.match(*patterns).frame
        return self._with(self._matched(found.select(*[c for c in found.columns if c in self.names]).distinct(), "left_semi"), self.unbound)

    def not_exists(self, *patterns: Pattern) -> Solutions:
        return self.minus(*patterns)

    def filter(self, condition: str | Column) -> Solutions:
        return self._with(self.frame.where(condition), self.unbound)

    def bind(self, name: str, value: str | Column) -> Solutions:
        return self._with(self.frame.withColumn(name, F.expr(value) if isinstance(value, str) else value), self.unbound | {name})

    def values(self, name: str, terms: list) -> Solutions:
        """Rows whose variable has one of the values."""
        return self._with(self.frame.where(F.col(name).isin(terms)), self.unbound)

    def union(self, *others: Solutions) -> Solutions:
        """All rows of all; a variable that one lacks is unbound there."""
        frame = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [o.frame for o in (self, *others)])
        everywhere = reduce(frozenset.intersection, [frozenset(o.names) for o in (self, *others)])
        return self._with(frame, frozenset(frame.columns) - everywhere | frozenset().union(*[o.unbound for o in (self, *others)]))

    def group(self, *by: str, **aggregates: Column) -> Solutions:
        """One row per value of the variables, or one in all."""
        frame = self.frame.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
        return self._with(frame, (self.unbound & set(by)) | set(aggregates))

    def select(self, *names: str) -> DataFrame:
        return self.frame.select(*names)

    def ask(self) -> DataFrame:
        """One row, found: whether there is a solution."""
        return self.frame.limit(1).agg((F.count("*") > 0).alias("found"))

    def construct(self, *templates: Pattern) -> DataFrame:
        """s, p, o: the distinct triples that the templates make of the rows; none from unbound variables."""
        part = lambda x: F.col(x[1:]).cast("string") if is_variable(x) else x.cast("string") if isinstance(x, Column) else F.lit(x)
        triples = F.array(*[F.struct(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in templates])
        return self.frame.select(F.inline(triples)).where("s is not null and p is not null and o is not null").distinct()


class Graph:
    """Triples: a table with string columns s, p and o."""

    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o")

    def _one(self, pattern: Pattern, seeds: Solutions | None) -> DataFrame:
        s, p, o = pattern
        if isinstance(p, Path):
            # A closure begins at the end that is known: a constant, or what the rows so far have for the variable.
            flip = not is_variable(o) and is_variable(s) or is_variable(s) and is_variable(o) and seeds is not None and o[1:] in seeds.names and s[1:] not in seeds.names
            s, o, p = (o, s, ~p if p.kind != "times" else Path("times", (~p.parts[0],), least=p.least, most=p.most)) if flip else (s, o, p)
            starts = None
            if not is_variable(s):
                starts = self.triples.sparkSession.createDataFrame([(s,)], "a string")
            elif seeds is not None and s[1:] in seeds.names:
                starts = seeds.frame.select(F.col(s[1:]).alias("a")).where("a is not null").distinct()
            found = steps(self.triples, p, starts).toDF("s", "o")
            parts = {"s": s, "o": o}
        else:
            found, parts = self.triples, {"s": s, "p": p, "o": o}
        first: dict[str, str] = {}
        for column, part in parts.items():
            if not is_variable(part):
                found = found.where(F.col(column) == part)
            elif part in first:
                found = found.where(F.col(column) == F.col(first[part]))
            else:
                first[part] = column
        return found.select(*[F.col(column).alias(part[1:]) for part, column in first.items()])

    def match(self, *patterns: Pattern, seeds: Solutions | None = None) -> Solutions:
        """Solutions of all patterns together, those with constants first, each joined to one it shares a variable with."""
        rest = sorted(patterns, key=lambda p: sum(is_variable(x) for x in p))
        frame: DataFrame | None = None
        while rest:
            known = frame.columns if frame is not None else (seeds.names if seeds is not None else [])
            pick = next((p for p in rest if any(v in known for v in variables([p]))), rest[0])
            rest.remove(pick)
            so_far = Solutions(self, frame) if frame is not None else seeds
            one = self._one(pick, so_far)
            if frame is None:
                frame = one
            else:
                shared = [c for c in one.columns if c in frame.columns]
                if not shared and one.columns:
                    raise ValueError(f"{pick} shares no variable with the patterns before it")
                frame = frame.join(one, shared) if shared else frame.where(F.lit(not one.isEmpty()))
        if frame is None:
            raise ValueError("no pattern")
        return Solutions(self, frame)

    def update(self, where: Solutions, *, delete: Iterable[Pattern] = (), insert: Iterable[Pattern] = ()) -> DataFrame:
        """s, p, o after an update: what ``delete`` makes of the matches goes, then what ``insert`` makes is added."""
        delete, insert, out = list(delete), list(insert), self.triples
        if delete:
            out = out.join(where.construct(*delete), ["s", "p", "o"], "left_anti")
        if insert:
            out = out.unionByName(where.construct(*insert))
        return out.distinct()

    def insert_data(self, rows: list[tuple[str, str, str]]) -> DataFrame:
        return self.triples.unionByName(self.triples.sparkSession.createDataFrame(rows, "s string, p string, o string")).distinct()
