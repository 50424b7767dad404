"""Spellings of the same relational expression for Spark SQL and for an independent engine that checks it."""

from __future__ import annotations


class Spark:
    name = "spark"

    def explode(self, array: str, alias: str) -> str:
        return f" LATERAL VIEW explode({array}) {alias}_t AS {alias}"

    def posexplode(self, array: str, pos: str, alias: str) -> str:
        """Positions from 0."""
        return f" LATERAL VIEW posexplode({array}) {alias}_t AS {pos}, {alias}"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {var} -> {body})"

    def keep(self, a: str, var: str, body: str) -> str:
        return f"filter({a}, {var} -> {body})"

    def total(self, a: str) -> str:
        return f"aggregate({a}, CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def zip_sum(self, a: str, b: str, body: str) -> str:
        """Sum over places of an expression of x (from a) and y (from b)."""
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST({body} AS DOUBLE)), CAST(0 AS DOUBLE), (s, z) -> s + z)"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def rx(self, x: str, p: str) -> str:
        return f"regexp_like({x}, r'{p}')"

    def rx_count(self, x: str, p: str) -> str:
        return f"CAST(regexp_count({x}, r'{p}') AS BIGINT)"

    def rx_replace(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, r'{p}', '{r}')"

    def rx_extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, r'{p}', {g})"

    def rx_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, r'{p}', 0)"

    def rx_split(self, x: str, p: str) -> str:
        return f"split({x}, r'{p}')"

    def seconds(self, ts: str) -> str:
        return f"CAST(unix_timestamp({ts}) AS BIGINT)"

    def plus_seconds(self, ts: str, n: str) -> str:
        return f"timestampadd(SECOND, CAST({n} AS INT), {ts})"

    def plus_days(self, d: str, n: str) -> str:
        return f"date_add({d}, CAST({n} AS INT))"

    def date_text(self, ts: str, java: str, strf: str) -> str:
        return f"date_format({ts}, '{java}')"

    def words_joined(self, x: str, sep: str, distinct: bool = True, order: str | None = None) -> str:
        if distinct:
            return f"array_join(array_sort(collect_set({x})), '{sep}')"
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order or x})"

    def collected(self, x: str, order: str | None = None) -> str:
        """A sorted array of distinct values."""
        return f"array_sort(collect_set({x}))"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, {start}, {n})"

    def sequence(self, a: str, b: str) -> str:
        """a to b; empty if b is less, where Spark's own function counts down."""
        return f"CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE array() END"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def deviation_over(self, x: str, frame: str) -> str:
        """stddev_pop over a window's frame, null over none. Mean and squares are updated value by value in the frame's
        order, as the checking engine does: what lies on a threshold then rounds to the same side."""
        mean = "s.mean + (x - s.mean) / (s.n + 1)"
        step = f"named_struct('n', s.n + 1, 'mean', {mean}, 'squares', s.squares + (x - ({mean})) * (x - s.mean))"
        return f"aggregate(collect_list(CAST({x} AS DOUBLE)) OVER ({frame}), named_struct('n', 0D, 'mean', 0D, 'squares', 0D), (s, x) -> {step}, s -> CASE WHEN s.n > 0 THEN sqrt(s.squares / s.n) END)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def hash_order(self, x: str) -> str:
        return f"md5({x})"

    def least_by(self, v: str, by: str) -> str:
        return f"min_by({v}, {by})"

    def at(self, a: str, i: str) -> str:
        """From 1; null beyond the end."""
        return f"try_element_at({a}, {i})"

    def strpos(self, x: str, y: str) -> str:
        return f"CAST(locate({y}, {x}) AS BIGINT)"

    def length(self, x: str) -> str:
        return f"CAST(length({x}) AS BIGINT)"

    recursive = "WITH RECURSIVE"


class Duck(Spark):
    name = "duck"

    def explode(self, array, alias):
        return f", unnest({array}) AS {alias}_t({alias})"

    def posexplode(self, array, pos, alias):
        return f", unnest(list_zip(range(0, len({array})), {array})) AS {alias}_z(z_{alias}), (SELECT z_{alias}[1] AS {pos}, z_{alias}[2] AS {alias}) AS {alias}_t"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def map(self, a, var, body):
        return f"list_transform({a}, lambda {var}: {body})"

    def keep(self, a, var, body):
        return f"list_filter({a}, lambda {var}: {body})"

    def total(self, a):
        return f"coalesce(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE))), 0.0)"

    def distinct(self, a):
        return f"list_distinct({a})"

    def intersect(self, a, b):
        return f"list_intersect({a}, {b})"

    def union(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def zip_sum(self, a, b, body):
        inner = body.replace("x", "z[1]").replace("y", "z[2]")
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST({inner} AS DOUBLE)))"

    def join(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def rx(self, x, p):
        return f"regexp_matches({x}, '{p}')"

    def rx_count(self, x, p):
        return f"CAST(len(regexp_extract_all({x}, '{p}')) AS BIGINT)"

    def rx_replace(self, x, p, r):
        return f"regexp_replace({x}, '{p}', '{r}', 'g')"

    def rx_extract(self, x, p, g=1):
        return f"regexp_extract({x}, '{p}', {g})"

    def rx_all(self, x, p):
        return f"regexp_extract_all({x}, '{p}')"

    def rx_split(self, x, p):
        return f"regexp_split_to_array({x}, '{p}')"

    def seconds(self, ts):
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def plus_seconds(self, ts, n):
        return f"({ts} + to_seconds(CAST({n} AS BIGINT)))"

    def plus_days(self, d, n):
        return f"CAST({d} + to_days(CAST({n} AS INTEGER)) AS DATE)"

    def date_text(self, ts, java, strf):
        return f"strftime({ts}, '{strf}')"

    def words_joined(self, x, sep, distinct=True, order=None):
        return f"string_agg({'DISTINCT ' if distinct else ''}{x}, '{sep}' ORDER BY {order or x})"

    def collected(self, x, order=None):
        return f"list_sort(list(DISTINCT {x}))"

    def slice(self, a, start, n):
        return f"({a})[{start}:{start} + {n} - 1]"

    def sequence(self, a, b):
        return f"range({a}, {b} + 1)"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"

    def deviation_over(self, x, frame):
        return f"stddev_pop({x}) OVER ({frame})"

    def sha256(self, x):
        return f"sha256({x})"

    def least_by(self, v, by):
        return f"arg_min({v}, {by})"

    def at(self, a, i):
        return f"({a})[{i}]"

    def strpos(self, x, y):
        return f"CAST(strpos({x}, {y}) AS BIGINT)"
