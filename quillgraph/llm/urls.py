"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history of dated entries: from its date on, an ``add`` puts a key on the list and a ``remove`` takes it off.
Entries become validity intervals; a capture is judged by the intervals that hold at its fetch date, an as-of join.
Keys are of three kinds: ``domain`` (a host and all below it), ``host`` (that host alone) and ``prefix`` (a host and
the first segments of its paths). Of several that hold, the most specific one is reported.

For the join, intervals are laid out by month, so a capture meets only those of its key and month and a key with a long
history costs no more than a short one. Captures are taken once per distinct URL and date. Intervals are broadcast only
if they are few; otherwise the join is shuffled and skewed keys are split by the engine.

A capture with a null or unreadable URL or a null date is never listed. Entries with a null key, kind, action or date
count for nothing; of an add and a remove of one key on one day the add counts. Repeated captures give repeated rows.
Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import settled, small

BROADCAST_ROWS = 20_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """The lower-case host of a URL, null if there is none."""
    h = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(h != "", h)


def segments(url: Column) -> Column:
    """The non-empty segments of a URL's path."""
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def domain_of(h: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(h, ".", -2)


def keys(url: Column) -> Column:
    """All keys by which a list may name a URL."""
    h, s = host(url), segments(url)
    labels = F.split(h, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    below = F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.concat_ws("/", F.concat(F.lit("prefix:"), h), F.slice(s, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))
    return F.concat(above, F.array(F.concat(F.lit("host:"), h)), below)


def intervals(entries: DataFrame) -> DataFrame:
    """key, since and until (exclusive; null: still open) of each time that a key is on the list.

    ``entries``: kind, value, action (add, remove), at (a date).
    """
    one = (
        entries.where("kind in ('domain', 'host', 'prefix') and action in ('add', 'remove') and value is not null and at is not null")
        .groupBy(F.concat_ws(":", "kind", F.lower("value")).alias("key"), F.col("at").cast("date").alias("since")).agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    )
    by_key = Window.partitionBy("key").orderBy("since")
    turns = one.withColumn("was", F.lag("on", 1, 0).over(by_key)).where("on <> was")
    return turns.withColumn("until", F.lead("since").over(by_key)).where("on = 1").select("key", "since", "until")


def judge(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """``captures`` with listed (boolean), rule (the entry's key) and listed_since, which replace columns of these names."""
    captures = captures.drop("listed", "rule", "listed_since")
    seen = captures.select(F.col(url_col).alias("u"), F.col(at_col).cast("date").alias("d")).where("u is not null and d is not null").distinct()
    span = seen.agg(F.min("d"), F.max("d")).first()
    if span[0] is None:
        return captures.select("*", F.lit(False).alias("listed"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("date").alias("listed_since"))
    held = intervals(entries).where((F.col("since") <= F.lit(span[1])) & (F.coalesce(F.col("until"), F.lit(span[1])) >= F.lit(span[0])))
    first, last = F.greatest("since", F.lit(span[0])), F.least(F.coalesce("until", F.lit(span[1])), F.lit(span[1]))
    by_month = settled(held.select("*", F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))).alias("month")))
    asked = seen.where(host(F.col("u")).isNotNull()).select("u", "d", F.trunc("d", "MM").alias("month"), F.explode(keys(F.col("u"))).alias("key"))
    hits = asked.join(small(by_month, BROADCAST_ROWS), ["key", "month"]).where("since <= d and (until is null or d < until)")
    kind = F.when(F.col("key").startswith("prefix:"), 3).when(F.col("key").startswith("host:"), 2).otherwise(1)
    best = hits.groupBy("u", "d").agg(F.max(F.struct(kind.alias("kind"), F.length("key").alias("long"), "key", "since")).alias("best"))
    out = captures.join(best, (F.col(url_col) == F.col("u")) & (F.col(at_col).cast("date") == F.col("d")), "left")
    return out.select(*[captures[c] for c in captures.columns], F.col("best").isNotNull().alias("listed"), F.col("best.key").alias("rule"), F.col("best.since").alias("listed_since"))


def sample_history(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with fetch dates and a list history, both derived from a table of pages by fixed rules."""
    day = lambda factor: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * factor % 366).cast("int"))
    captures = pages.select("page_id", "url", day(37).alias("fetched"))
    h = host(F.col("url"))
    kind = F.when(F.col("page_id") % 3 == 0, "domain").when(F.col("page_id") % 3 == 1, "host").otherwise("prefix")
    value = F.when(F.col("page_id") % 3 == 0, domain_of(h)).when(F.col("page_id") % 3 == 1, h).otherwise(F.concat_ws("/", h, F.element_at(segments(F.col("url")), 1)))
    entries = pages.where("page_id % 5 = 0 and url is not null").select(kind.alias("kind"), value.alias("value"), F.when(F.floor(F.col("page_id") / 5) % 3 == 2, "remove").otherwise("add").alias("action"), day(53).alias("at"))
    return captures, entries


SQL = rf"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched, CAST(DATE '2024-01-01' + CAST(page_id * 53 % 366 AS INTEGER) AS DATE) AS day2,
    nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda s: s <> '') AS seg FROM pages
), l AS (SELECT *, string_split(host, '.') AS labels FROM p),
e AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'domain:' || lower(CASE WHEN len(labels) > 1 THEN array_to_string(labels[-2:], '.') ELSE host END) WHEN 1 THEN 'host:' || host ELSE 'prefix:' || lower(CASE WHEN len(seg) > 0 THEN host || '/' || seg[1] ELSE host END) END AS key,
    day2 AS since, max(CASE WHEN (page_id // 5) % 3 = 2 THEN 0 ELSE 1 END) AS active FROM l WHERE page_id % 5 = 0 AND url IS NOT NULL AND host IS NOT NULL GROUP BY 1, 2
), t AS (SELECT * FROM (SELECT *, lag(active, 1, 0) OVER (PARTITION BY key ORDER BY since) AS was FROM e) WHERE active <> was),
i AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM t) WHERE active = 1),
k AS (
  SELECT page_id, fetched, unnest(list_concat(list_concat(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda x: 'domain:' || array_to_string(labels[x:], '.')), ['host:' || host]),
    list_transform(range(1, len(seg) + 1), lambda x: 'prefix:' || host || '/' || array_to_string(seg[:x], '/')))) AS key FROM l WHERE host IS NOT NULL
), h AS (
  SELECT k.page_id, k.key, i.since, row_number() OVER (PARTITION BY k.page_id ORDER BY CASE WHEN k.key LIKE 'prefix:%' THEN 3 WHEN k.key LIKE 'host:%' THEN 2 ELSE 1 END DESC, length(k.key) DESC, k.key DESC, i.since DESC) AS r
  FROM k JOIN i ON k.key = i.key AND i.since <= k.fetched AND (i.until IS NULL OR k.fetched < i.until)
)
SELECT p.page_id, p.url, p.fetched, h.key IS NOT NULL AS listed, h.key AS rule, h.since AS listed_since FROM p LEFT JOIN h ON p.page_id = h.page_id AND h.r = 1
"""
