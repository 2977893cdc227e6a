"""URL filters by a temporal list join (DataFrame operations only).

Lists are logs of dated entries (list, kind, pattern, action add or remove, day). Each add becomes the validity interval
from its day to the next entry of the same list, kind and pattern. A capture is looked up by the keys that can match it
(its host, every parent domain of at least two labels, and host with first path segment); the intervals that hold its
fetch day are active. The most specific active entry decides; on equal kinds, block before allow.

Defined results: a null or unparsable URL has no keys and is kept with no match; captures without a day match nothing;
repeated captures each get their row; entries with a null part are ignored, repeated entries count once; on one day, a
remove comes before an add; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: How specific a kind is.
RANK = {"prefix": 3, "host": 2, "domain": 1}


def host_of(url: Column) -> Column:
    """Lower-case host without credentials and port; null if the URL has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def segment_of(url: Column) -> Column:
    """The first path segment; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """list, action_kind (block or allow), kind, pattern, valid_from, valid_to (null: still valid) of every add."""
    e = entries.select("list", "verdict", "kind", "pattern", "action", "day").dropna().distinct()
    w = Window.partitionBy("list", "kind", "pattern").orderBy("day", F.desc("action"), "verdict")
    e = e.withColumn("valid_to", F.lead("day").over(w))
    return e.filter(F.col("action") == "add").filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))).select("list", "verdict", "kind", "pattern", F.col("day").alias("valid_from"), "valid_to")


def keys_of(captures: DataFrame) -> DataFrame:
    """A row for each capture and key under which an entry can match it."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), k), ".").alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")), F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "segment").alias("pattern")))
    return captures.filter("host IS NOT NULL AND day IS NOT NULL").select("page_id", "host", "day", F.explode(F.array_distinct(F.concat(own, F.when(n >= 2, parents).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))))).alias("key")).select("page_id", "host", "day", "key.kind", "key.pattern")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, day, n_active, verdict (block, allow or none), kind, pattern, valid_from of each capture.

    captures: page_id, url, day. The keys are joined with the intervals by equality, which splits hot hosts, and reduced
    to counts and the best entry before they meet in one row a capture.
    """
    c = captures.select("page_id", F.col("url").alias("its_url"), "day")
    c = c.select("page_id", host_of(F.col("its_url")).alias("host"), segment_of(F.col("its_url")).alias("segment"), "day")
    # Captures of one host, segment and day meet the same entries: they are evaluated once.
    distinct = c.select("host", "segment", "day").distinct().withColumn("page_id", F.struct("host", "segment", "day"))
    k = keys_of(distinct)
    v = validity(entries)
    active = k.join(v, (k["kind"] == v["kind"]) & (k["pattern"] == v["pattern"]) & (v["valid_from"] <= k["day"]) & (v["valid_to"].isNull() | (k["day"] < v["valid_to"]))).select(k["page_id"], v["kind"], v["pattern"], "verdict", "valid_from")
    rank = F.lit(0)
    for kind, r in RANK.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    # The longer pattern of a kind is the more specific one.
    best = F.struct(rank.alias("rank"), F.length("pattern").alias("length"), (F.col("verdict") == "block").alias("blocks"), F.col("valid_from"), "pattern", "kind", "verdict")
    found = active.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_active"), F.max(best).alias("best")).select(F.col("page_id.host").alias("f_host"), F.col("page_id.segment").alias("f_segment"), F.col("page_id.day").alias("f_day"), "n_active", "best")
    same = (c["host"] == found["f_host"]) & c["segment"].eqNullSafe(found["f_segment"]) & (c["day"] == found["f_day"])
    return c.join(found, same, "left").select("page_id", "host", "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("valid_from"))


def _digits(pattern: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(pattern), at, n), 16, 10).cast("int")


def demo_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time: a day of 2024 from the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")).alias("day"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A log made from the pages' own hosts: patterns, days and verdicts by the digits of their md5."""
    c = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).filter("host IS NOT NULL").distinct()
    patterns = c.select(F.explode(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")), F.struct(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern")), F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "segment").alias("pattern")))).alias("p")).select("p.*").filter("pattern <> ''").distinct()
    p = F.concat_ws(":", "kind", "pattern")
    start = F.date_add(F.lit("2023-10-01").cast("date"), _digits(p, 3, 4) % 300)
    rows = [F.struct(F.lit("add").alias("action"), start.alias("day")), F.struct(F.lit("remove").alias("action"), F.date_add(start, 20 + _digits(p, 7, 4) % 120).alias("day")), F.struct(F.lit("add").alias("action"), F.date_add(start, 150 + _digits(p, 11, 4) % 90).alias("day"))]
    listed = patterns.filter(_digits(p, 1, 2) < 160)
    return listed.select(F.lit("harm").alias("list"), F.when(_digits(p, 15, 2) % 4 == 0, "allow").otherwise("block").alias("verdict"), "kind", "pattern", F.explode(F.array(*rows)).alias("e")).select("list", "verdict", "kind", "pattern", "e.action", "e.day")


ORACLE = r"""
WITH c AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1), '') AS segment,
         DATE '2024-01-01' + ((page_id * 7919) % 366)::INT AS day
  FROM pages),
pat AS (
  SELECT DISTINCT kind, pattern FROM (
    SELECT 'host' AS kind, host AS pattern FROM c WHERE host IS NOT NULL
    UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c WHERE host IS NOT NULL
    UNION ALL SELECT 'prefix', concat_ws('/', host, segment) FROM c WHERE host IS NOT NULL) WHERE pattern <> ''),
h AS (SELECT kind, pattern, md5(kind || ':' || pattern) AS m FROM pat),
d AS (SELECT kind, pattern, ('0x' || substr(m, 1, 2))::INT AS x1, ('0x' || substr(m, 3, 4))::INT AS x3, ('0x' || substr(m, 7, 4))::INT AS x7,
             ('0x' || substr(m, 11, 4))::INT AS x11, ('0x' || substr(m, 15, 2))::INT AS x15 FROM h),
v AS (
  SELECT kind, pattern, CASE WHEN x15 % 4 = 0 THEN 'allow' ELSE 'block' END AS verdict,
         DATE '2023-10-01' + (x3 % 300) AS valid_from, DATE '2023-10-01' + (x3 % 300) + (20 + x7 % 120) AS valid_to FROM d WHERE x1 < 160
  UNION ALL
  SELECT kind, pattern, CASE WHEN x15 % 4 = 0 THEN 'allow' ELSE 'block' END, DATE '2023-10-01' + (x3 % 300) + (150 + x11 % 90), NULL FROM d WHERE x1 < 160),
hit AS (
  SELECT c.page_id, v.* FROM c JOIN v ON v.kind = 'host' AND v.pattern = c.host AND c.day >= v.valid_from AND (v.valid_to IS NULL OR c.day < v.valid_to)
  UNION ALL
  SELECT c.page_id, v.* FROM c JOIN v ON v.kind = 'domain' AND v.pattern = regexp_extract(c.host, '([^.]+\.[^.]+)$', 1) AND c.day >= v.valid_from AND (v.valid_to IS NULL OR c.day < v.valid_to)
  UNION ALL
  SELECT c.page_id, v.* FROM c JOIN v ON v.kind = 'prefix' AND v.pattern = concat_ws('/', c.host, c.segment) AND c.day >= v.valid_from AND (v.valid_to IS NULL OR c.day < v.valid_to)),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active,
         row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(pattern) DESC, (verdict = 'block') DESC, valid_from DESC) AS r FROM hit)
SELECT c.page_id, c.host, c.day::DATE AS day, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(verdict, 'none') AS verdict, kind, pattern, valid_from::DATE AS valid_from
FROM c LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (page_id)
"""
