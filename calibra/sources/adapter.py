"""The driver's tables as the suite's semantic views: trades, markets, ticks and chain-style fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an executed trade. Filters on raw columns still reach the scan."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS ticker", "cast(l_quantity AS bigint) AS cnt", "cast(1 + l_partkey % 99 AS int) AS yes_price", "cast(99 - l_partkey % 99 AS int) AS no_price",
        "CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS side", "cast(l_shipdate AS date) AS traded_on",
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ticker", "o_custkey AS event_id", "CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'finalized' END AS status",
        "CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '' END AS result", "o_totalprice AS volume", "cast(o_orderdate AS date) AS opened_on",
    )


def resolved(spark: SparkSession, sf_dir: str, finalized: bool = True) -> DataFrame:
    """Markets with a binary outcome; ``finalized`` also asks for their status."""
    known = markets(spark, sf_dir).where("result IN ('yes', 'no')")
    return known.where("status = 'finalized'") if finalized else known


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday trades of the event stream."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS trade_id", "user_id AS ticker", "cast(1 + floor(value) % 99 AS int) AS price", "cast(1 + event_id % 20 AS bigint) AS cnt", "ts", "event_type AS kind", "props")


#: Titles of the order markets, in words that both engines read alike: six kinds of proposition by the order's key.
_PLACE = "'{}' || lower(c_mktsegment) || '{}' || lower(replace(n_name, '_', ' ')) || ' in the ' || lower(r_name) || ' region{}'"
_YEAR = "CAST(year(o_orderdate) AS STRING)"
_TOTAL = "CAST(floor(o_totalprice) AS BIGINT)"
TITLE = (
    "CASE o_orderkey % 6 WHEN 0 THEN " + _PLACE.format("Will ", " orders from ", " pass a total in ") + f" || {_YEAR} || '?'"
    " WHEN 1 THEN 'How large will the ' || lower(substr(o_orderpriority, 3)) || ' priority order be, ' || " + _PLACE.format("", " from ", "?")
    + " WHEN 2 THEN " + _PLACE.format("Will ", " orders from ", " stay low in ") + f" || {_YEAR} || '?'"
    " WHEN 3 THEN " + _PLACE.format("Who is the winner of the ", " contract of ", "?")
    + " WHEN 4 THEN " + _PLACE.format("Will the ", " order from ", " ship with ") + " || lower(substr(o_orderpriority, 3)) || ' priority?'"
    " ELSE " + _PLACE.format("What will be the sum of ", " orders from ", " in ") + f" || {_YEAR} || '?' END"
)
SUBTITLE = f"CASE o_orderkey % 6 WHEN 0 THEN 'Above ' || CAST({_TOTAL} AS STRING) WHEN 1 THEN CAST({_TOTAL} AS STRING) || ' to ' || CAST({_TOTAL} + 5000 AS STRING) WHEN 2 THEN 'Below ' || CAST({_TOTAL} AS STRING) WHEN 3 THEN 'Supplier ' || CAST(o_orderkey % 97 AS STRING) WHEN 5 THEN 'At least ' || CAST({_TOTAL} AS STRING) ELSE '' END"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with titles, made of the order, its customer's segment, nation and region."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    known = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    result = "CASE WHEN o_orderstatus = 'F' THEN 'yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE '' END AS result"
    return known.selectExpr("o_orderkey AS ticker", "o_custkey AS event_id", "upper(c_mktsegment) || '-' || o_custkey AS event_ticker", f"{TITLE} AS title", f"{SUBTITLE} AS yes_sub_title", "n_name", result)


#: The same views for DuckDB; every query's SQL begins with them.
SQL = """
WITH trades AS (SELECT l_orderkey AS ticker, CAST(l_quantity AS BIGINT) AS cnt, CAST(1 + l_partkey % 99 AS INTEGER) AS yes_price, CAST(99 - l_partkey % 99 AS INTEGER) AS no_price,
  CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS side, CAST(l_shipdate AS DATE) AS traded_on FROM lineitem),
markets AS (SELECT o_orderkey AS ticker, o_custkey AS event_id, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'finalized' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '' END AS result, o_totalprice AS volume, CAST(o_orderdate AS DATE) AS opened_on FROM orders),
resolved AS (SELECT * FROM markets WHERE status = 'finalized' AND result IN ('yes', 'no')),
joined AS (SELECT t.*, r.result, r.event_id FROM trades t JOIN resolved r USING (ticker)),
positions AS (
  SELECT ticker, event_id, cnt, traded_on, 'taker' AS role, side AS direction, CASE WHEN side = 'yes' THEN yes_price ELSE no_price END AS price, CAST(side = result AS INTEGER) AS won FROM joined
  UNION ALL
  SELECT ticker, event_id, cnt, traded_on, 'maker', CASE WHEN side = 'yes' THEN 'no' ELSE 'yes' END, CASE WHEN side = 'yes' THEN no_price ELSE yes_price END, CAST(side <> result AS INTEGER) FROM joined),
ticks AS (SELECT event_id AS trade_id, user_id AS ticker, CAST(1 + floor(value) % 99 AS INTEGER) AS price, CAST(1 + event_id % 20 AS BIGINT) AS cnt, ts, event_type AS kind, props FROM events),
customers AS (SELECT c_custkey AS event_id, upper(c_mktsegment) AS segment, n_name, r_name, upper(c_mktsegment) || '-' || c_custkey AS event_ticker
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
#: And that of contracts, for the queries on titles.
CONTRACTS_SQL = f""", contracts AS (SELECT o_orderkey AS ticker, o_custkey AS event_id, upper(c_mktsegment) || '-' || o_custkey AS event_ticker, {TITLE} AS title, {SUBTITLE} AS yes_sub_title, n_name,
  CASE WHEN o_orderstatus = 'F' THEN 'yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE '' END AS result
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
