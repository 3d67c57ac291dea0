"""URL filters by temporal list join.

Dated list entries become validity intervals: an entry holds until the next entry of the same key. An as-of join gives
every capture the entry of its host, or of the nearest parent domain, that was active when it was fetched. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.llm.common import table

#: Copies of the hosts' timelines that a hot host's captures are dealt over.
SALTS = 16
DAY_0 = "2024-01-01"


def host_of(url: Column) -> Column:
    """The lower-case host without user, port or final dot; null where there's none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def parents(host: Column) -> Column:
    """The host and its parent domains of two labels at least, the most specific first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, listed_on, action) -> (key, action, valid_from, valid_to): valid_to is the next entry's date, or null.

    Of entries of one key and day, the last in the order of action counts. Entries without key or date have no effect.
    """
    own = entries.select(F.lower("key").alias("key"), F.col("listed_on").cast("date").alias("valid_from"), F.col("action").cast("string").alias("action"))
    own = own.dropna(subset=["key", "valid_from"]).groupBy("key", "valid_from").agg(F.max("action").alias("action"))
    return own.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")))


def url_filters(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """captures (page_id, url, fetched_on) with the entry active at fetch time: host, list_key, action, valid_from, keep.

    The nearest key wins: the host's own active entry, else its parent's, and so on. 'remove' ends an entry without a
    new one. keep is false for 'block' alone. Captures with a null or unreadable URL or no date have no entry and are
    kept; repeated rows give a row each; empty tables are fine; extra columns are left behind. Lists of any size are
    joined by host, never sent to all executors; captures of a hot host are dealt over ``salts`` copies of its timeline.
    """
    taken = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on"), host_of(F.col("url")).alias("host"))
    hosts = taken.select("host").where(F.col("host").isNotNull()).distinct()
    keys = hosts.select("host", F.posexplode(parents(F.col("host"))).alias("level", "list_key"))
    spans = intervals(entries).where(F.col("action") != "remove")
    timeline = keys.join(spans, keys["list_key"] == spans["key"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("level", "valid_from", "valid_to", "list_key", "action"))).alias("spans"))
    dealt = timeline.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = taken.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched_on"), F.lit(salts)).cast("int"))
    day = F.col("fetched_on")
    active = F.filter("spans", lambda s: (s["valid_from"] <= day) & (s["valid_to"].isNull() | (day < s["valid_to"])))
    found = salted.join(dealt, ["host", "salt"], "left").withColumn("entry", F.get(active, F.lit(0)))
    return found.select("page_id", "url", "host", "fetched_on", F.col("entry.list_key").alias("list_key"), F.coalesce("entry.action", F.lit("none")).alias("action"), F.col("entry.valid_from").alias("valid_from"), (F.coalesce("entry.action", F.lit("none")) != "block").alias("keep"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch date: the table has none, so day page_id mod 731 of two years stands for it."""
    return pages.select("page_id", "url", F.date_add(F.lit(DAY_0).cast("date"), F.pmod("page_id", F.lit(731)).cast("int")).alias("fetched_on"))


def drawn_entries(captures: DataFrame) -> DataFrame:
    """A list drawn from the hosts by the first 32 bits b of their MD5: entries of every three-label domain, and of some hosts.

    A domain has block (b mod 3 = 0) or allow on day b mod 365, then the opposite, or remove where b mod 7 = 0, on day
    365 + b mod 300; a host with b mod 5 = 0 has block on day b mod 700.
    """
    b = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long")
    on = lambda n: F.date_add(F.lit(DAY_0).cast("date"), n.cast("int"))
    hosts = captures.select(host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("key")).where(F.col("key") != "").distinct().withColumn("b", b)
    first = F.when(F.col("b") % 3 == 0, "block").otherwise("allow")
    then = F.when(F.col("b") % 7 == 0, "remove").when(F.col("b") % 3 == 0, "allow").otherwise("block")
    own = hosts.select(F.col("host").alias("key")).withColumn("b", b).where(F.col("b") % 5 == 0)
    pairs = domains.select("key", F.explode(F.array(F.struct(on(F.col("b") % 365).alias("listed_on"), first.alias("action")), F.struct(on(F.col("b") % 300 + 365).alias("listed_on"), then.alias("action")))).alias("e"))
    return pairs.select("key", "e.listed_on", "e.action").union(own.select("key", on(F.col("b") % 700), F.lit("block")))


def op10(spark, sf_dir: str) -> DataFrame:
    captures = dated_captures(table(spark, sf_dir, "pages"))
    return url_filters(captures, drawn_entries(captures))


ORACLE = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 731) + 731) % 731 AS INTEGER) AS DATE) AS fetched_on,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS k FROM hosts),
numbered AS (SELECT k, CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) AS b FROM domains WHERE k <> ''),
own AS (SELECT host AS k, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS b FROM hosts),
entries AS (
  SELECT k, CAST(DATE '2024-01-01' + CAST(b % 365 AS INTEGER) AS DATE) AS listed_on, CASE WHEN b % 3 = 0 THEN 'block' ELSE 'allow' END AS action FROM numbered
  UNION ALL
  SELECT k, CAST(DATE '2024-01-01' + CAST(b % 300 + 365 AS INTEGER) AS DATE), CASE WHEN b % 7 = 0 THEN 'remove' WHEN b % 3 = 0 THEN 'allow' ELSE 'block' END FROM numbered
  UNION ALL
  SELECT k, CAST(DATE '2024-01-01' + CAST(b % 700 AS INTEGER) AS DATE), 'block' FROM own WHERE b % 5 = 0),
daily AS (SELECT k, listed_on AS valid_from, max(action) AS action FROM entries GROUP BY k, listed_on),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY k ORDER BY valid_from) AS valid_to FROM daily),
found AS (
  SELECT c.page_id, c.url, c.fetched_on, s.k, s.action, s.valid_from,
         row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(s.k) DESC) AS nth
  FROM captures c JOIN spans s ON s.action <> 'remove' AND (c.host = s.k OR ends_with(c.host, '.' || s.k))
   AND s.valid_from <= c.fetched_on AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to))
SELECT c.page_id, c.url, c.host, c.fetched_on, f.k AS list_key, coalesce(f.action, 'none') AS action, f.valid_from,
       coalesce(f.action, 'none') <> 'block' AS keep
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id AND f.nth = 1
"""
