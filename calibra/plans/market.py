"""Categories, audits, splits, chain-style fills and set operations."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.functions.buckets import decile, leading_category, portable_bucket, quarter_label, seeded_order
from calibra.operators.positions import joined, positions
from calibra.operators.rules import RuleTable
from calibra.plans.base import onward, query
from calibra.sources import adapter
from calibra.sources.adapter import table
from calibra.sources.readers import valid_trade

#: Our own small rule set, by segment; the first pattern found counts.
RULES = RuleTable([("AUTO", "Industry"), ("MACHIN", "Industry"), ("BUILD", "Property"), ("HOUSE", "Property")], ("grp",))
_RULE = "CASE WHEN upper({0}) LIKE '%AUTO%' THEN 'Industry' WHEN upper({0}) LIKE '%MACHIN%' THEN 'Industry' WHEN upper({0}) LIKE '%BUILD%' THEN 'Property' WHEN upper({0}) LIKE '%HOUSE%' THEN 'Property' ELSE 'Other' END"


def customers(spark, sf_dir):
    """Events with their category tree: region, nation, segment."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    tree = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return tree.selectExpr("c_custkey AS event_id", "upper(c_mktsegment) AS segment", "n_name", "r_name", "concat(upper(c_mktsegment), '-', c_custkey) AS event_ticker")


@query("category_returns", f""", c AS (SELECT p.*, coalesce(nullif(regexp_extract(k.event_ticker, '^([A-Z0-9]+)', 1), ''), 'independent') AS category FROM positions p JOIN customers k USING (event_id)),
g AS (SELECT category, {_RULE.format('category')} AS grp, role, sum(cnt) AS w, sum(cnt * (100 * won - price)) AS cents, count(*) AS n, sum(cnt * price) AS vol FROM c GROUP BY ALL)
SELECT grp, sum(cents) FILTER (role = 'taker') * 1.0 / sum(w) FILTER (role = 'taker') AS taker_excess, sum(cents) FILTER (role = 'maker') * 1.0 / sum(w) FILTER (role = 'maker') AS maker_excess, CAST(sum(n) AS BIGINT) AS n, CAST(sum(vol) AS BIGINT) AS volume_cents, CAST(sum(cents) FILTER (role = 'taker') AS BIGINT) AS taker_pnl FROM g GROUP BY grp""")
def category_returns(spark, sf_dir):
    """Sums by event in the pass that joins, then categories of the few events, then groups of the distinct categories.

    A maker has what its taker loses, and a trade's two prices add up to 100: the taker's sums give both sides.
    """
    won = F.expr("100 * cast(side = result AS int) - CASE WHEN side = 'yes' THEN yes_price ELSE no_price END")
    e = joined(spark, sf_dir).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("w"), F.sum(F.col("cnt") * won).alias("cents"))
    k = customers(spark, sf_dir).select("event_id", leading_category(F.col("event_ticker")).alias("category"))
    c = e.join(k, "event_id").groupBy("category").agg(*[F.sum(x).alias(x) for x in ("n", "w", "cents")])
    g = RULES.classify(c, "category").groupBy("grp").agg(*[F.sum(x).alias(x) for x in ("n", "w", "cents")])
    return g.selectExpr("grp", "cents * 1d / w AS taker_excess", "-cents * 1d / w AS maker_excess", "2 * n AS n", "100 * w AS volume_cents", "cents AS taker_pnl")


@query("category_tree", """SELECT r_name, n_name, segment, count(*) AS market_count, CAST(sum(CAST(round(volume * 100) AS BIGINT)) AS BIGINT) AS volume_cents, CAST(grouping(r_name) + grouping(n_name) + grouping(segment) AS INTEGER) AS depth FROM markets JOIN customers USING (event_id) GROUP BY ROLLUP (r_name, n_name, segment)""")
def category_tree(spark, sf_dir):
    m = adapter.markets(spark, sf_dir).join(customers(spark, sf_dir), "event_id")
    return m.rollup("r_name", "n_name", "segment").agg(F.count(F.lit(1)).alias("market_count"), F.expr("sum(cast(round(volume * 100) AS bigint))").alias("volume_cents"), (F.grouping("r_name").cast("int") + F.grouping("n_name").cast("int") + F.grouping("segment").cast("int")).alias("depth"))


def series_events(spark, sf_dir):
    """Events with a finer series: segment, nation and one of 40 lists, as in MACHINERYN7P31-1231."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr("c_custkey AS event_id", "upper(c_mktsegment) || 'N' || c_nationkey || 'P' || c_custkey % 40 || '-' || c_custkey AS event_ticker")


def series_rules(spark, sf_dir) -> RuleTable:
    """Rules made of the tables: each segment of nations 0 to 19, what is left of nations 0 to 21, one segment elsewhere.

    A longer pattern comes before one that it holds; nations 22 to 24 have no other rule.
    """
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    segments = table(spark, sf_dir, "customer").selectExpr("upper(c_mktsegment) AS segment").distinct()
    fine = nations.where("n_nationkey < 20").join(segments)  # five segments
    rules = fine.selectExpr("1 AS tier", "segment || 'N' || n_nationkey || 'P' AS pattern", "r_name AS grp", "n_name AS mid", "initcap(segment) AS sub")
    rules = rules.union(nations.where("n_nationkey < 22").selectExpr("2", "'N' || n_nationkey || 'P'", "r_name", "n_name", "'Rest of ' || n_name"))
    rules = rules.union(spark.sql("SELECT 3, 'HOUSEHOLD', 'Household', 'Household', 'Household'"))
    return RuleTable.read(rules, ("grp", "mid", "sub"), priority="tier")


def pruned_tree(leaves, least: float = 0.01):
    """leaves (grp, mid, sub, volume, n) -> (depth, grp, mid, sub, volume, n, children): the tree, without nodes under ``least`` of their parent.

    A node that goes takes what is below it along; parents keep their volume. A single child of its parent's name is
    left out, as its parent says the same. Windows over the few nodes of a parent, not a pass a level.
    """
    volume = F.sum("volume").alias("volume")
    sub = leaves.groupBy("grp", "mid", "sub").agg(volume, F.sum("n").alias("n"))
    of_mid, of_grp = Window.partitionBy("grp", "mid"), Window.partitionBy("grp")
    sub = sub.withColumns({"v2": F.sum("volume").over(of_mid), "n2": F.sum("n").over(of_mid), "v1": F.sum("volume").over(of_grp), "n1": F.sum("n").over(of_grp)})
    sub = sub.withColumns({"keep2": F.col("v2") >= least * F.col("v1"), "keep3": F.col("volume") >= least * F.col("v2")})
    kids = F.count_if("keep3").over(of_mid)
    sub = sub.withColumn("kids", F.when((kids == 1) & (F.max(F.when(F.col("keep3"), F.col("sub"))).over(of_mid) == F.col("mid")), 0).otherwise(kids))
    mids = sub.groupBy("grp", "mid", "v1", "n1", "v2", "n2", "keep2", "kids").agg(F.lit(1))
    groups = mids.groupBy("grp", "v1", "n1").agg(F.count_if("keep2").alias("kids"))
    none = F.lit(None).cast("string")
    out = groups.select(F.lit(1).alias("depth"), "grp", none.alias("mid"), none.alias("sub"), F.col("v1").alias("volume"), F.col("n1").alias("n"), F.col("kids").alias("children"))
    out = out.union(mids.where("keep2").select(F.lit(2), "grp", "mid", none, "v2", "n2", "kids"))
    return out.union(sub.where("keep2 AND keep3 AND kids > 0").select(F.lit(3), "grp", "mid", "sub", "volume", "n", F.lit(0).cast("long")))


_RULED = """, series AS (SELECT c_custkey AS event_id, regexp_extract(upper(c_mktsegment) || 'N' || c_nationkey || 'P' || c_custkey % 40 || '-' || c_custkey, '^([A-Z0-9]+)', 1) AS category FROM customer),
rules AS (SELECT DISTINCT 1 AS tier, upper(c_mktsegment) || 'N' || n_nationkey || 'P' AS pattern, r_name AS grp, n_name AS mid, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS sub FROM customer, nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20
  UNION ALL SELECT 2, 'N' || n_nationkey || 'P', r_name, n_name, 'Rest of ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 22
  UNION ALL SELECT 3, 'HOUSEHOLD', 'Household', 'Household', 'Household'),
v AS (SELECT category, sum(CAST(round(volume * 100) AS BIGINT)) AS volume, count(*) AS n FROM markets JOIN series USING (event_id) GROUP BY category),
h AS (SELECT v.*, r.grp, r.mid, r.sub, row_number() OVER (PARTITION BY v.category ORDER BY r.tier, r.pattern) AS nth FROM v LEFT JOIN rules r ON contains(v.category, r.pattern)),
l AS (SELECT category, coalesce(grp, 'Other') AS grp, coalesce(mid, 'Other') AS mid, coalesce(sub, category) AS sub, volume, n FROM h WHERE nth = 1)
"""


def ruled_categories(spark, sf_dir):
    """Volume and markets of each series, with its group, category and subcategory."""
    by_event = adapter.markets(spark, sf_dir).groupBy("event_id").agg(F.expr("sum(cast(round(volume * 100) AS bigint))").alias("volume"), F.count(F.lit(1)).alias("n"))
    k = series_events(spark, sf_dir).select("event_id", leading_category(F.col("event_ticker")).alias("category"))
    v = by_event.join(k, "event_id").groupBy("category").agg(F.sum("volume").alias("volume"), F.sum("n").alias("n"))
    return series_rules(spark, sf_dir).classify(v, "category")


@query("category_hierarchy", _RULED + "SELECT category, grp, mid, sub, CAST(volume AS BIGINT) AS volume_cents, n AS markets FROM l")
def category_hierarchy(spark, sf_dir):
    return ruled_categories(spark, sf_dir).select("category", "grp", "mid", "sub", F.col("volume").alias("volume_cents"), F.col("n").alias("markets"))


@query("category_treemap", _RULED + """, s AS (SELECT grp, mid, sub, sum(volume) AS volume, sum(n) AS n FROM l GROUP BY ALL),
m AS (SELECT grp, mid, sum(volume) AS volume, sum(n) AS n FROM l GROUP BY ALL), g AS (SELECT grp, sum(volume) AS volume, sum(n) AS n FROM l GROUP BY ALL),
km AS (SELECT m.* FROM m JOIN g USING (grp) WHERE m.volume >= 0.01 * g.volume),
ks AS (SELECT s.* FROM s JOIN km ON km.grp = s.grp AND km.mid = s.mid WHERE s.volume >= 0.01 * km.volume),
c AS (SELECT grp, mid, CASE WHEN count(*) = 1 AND max(sub) = mid THEN 0 ELSE count(*) END AS kids FROM ks GROUP BY grp, mid)
SELECT 1 AS depth, g.grp, NULL AS mid, NULL AS sub, CAST(g.volume AS BIGINT) AS volume_cents, CAST(g.n AS BIGINT) AS markets, (SELECT count(*) FROM km WHERE km.grp = g.grp) AS children FROM g
UNION ALL SELECT 2, km.grp, km.mid, NULL, CAST(km.volume AS BIGINT), CAST(km.n AS BIGINT), coalesce(c.kids, 0) FROM km LEFT JOIN c ON c.grp = km.grp AND c.mid = km.mid
UNION ALL SELECT 3, ks.grp, ks.mid, ks.sub, CAST(ks.volume AS BIGINT), CAST(ks.n AS BIGINT), 0 FROM ks JOIN c ON c.grp = ks.grp AND c.mid = ks.mid WHERE c.kids > 0""")
def category_treemap(spark, sf_dir):
    """The category tree by volume, without nodes under 1 % of their parent."""
    return pruned_tree(ruled_categories(spark, sf_dir)).withColumnsRenamed({"volume": "volume_cents", "n": "markets"})


@query("category_top_n", """, v AS (SELECT r_name, n_name, sum(CAST(round(volume * 100) AS BIGINT)) AS c, count(*) AS n FROM markets JOIN customers USING (event_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY c DESC, n_name) AS rn FROM v)
SELECT r_name, CASE WHEN rn <= 3 THEN n_name ELSE 'Other' END AS child, CAST(sum(c) AS BIGINT) AS volume_cents, CAST(sum(n) AS BIGINT) AS market_count FROM k GROUP BY ALL""")
def category_top_n(spark, sf_dir):
    v = adapter.markets(spark, sf_dir).join(customers(spark, sf_dir), "event_id").groupBy("r_name", "n_name").agg(F.expr("sum(cast(round(volume * 100) AS bigint))").alias("c"), F.count(F.lit(1)).alias("n"))
    k = v.withColumn("rn", F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("c"), "n_name")))
    return k.groupBy("r_name", F.when(F.col("rn") <= 3, F.col("n_name")).otherwise("Other").alias("child")).agg(F.sum("c").alias("volume_cents"), F.sum("n").alias("market_count"))


@query("meta_stats", "SELECT count(*) AS n_trades, CAST(sum(cnt) AS BIGINT) AS contracts, count(DISTINCT ticker) AS tickers, (SELECT count(*) FROM markets) AS n_markets, (SELECT count(*) FROM resolved) AS n_resolved, (SELECT count(DISTINCT event_id) FROM markets) AS n_events, min(traded_on) AS first_day, max(traded_on) AS last_day FROM trades")
def meta_stats(spark, sf_dir):
    t = adapter.trades(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_trades"), F.sum("cnt").alias("contracts"), F.countDistinct("ticker").alias("tickers"), F.min("traded_on").alias("first_day"), F.max("traded_on").alias("last_day"))
    m = adapter.markets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_markets"), F.count_if((F.col("status") == "finalized") & F.col("result").isin("yes", "no")).alias("n_resolved"), F.countDistinct("event_id").alias("n_events"))
    return t.crossJoin(m)  # one row each


_META = (("trades", "n_trades"), ("contracts", "contracts"), ("traded markets", "tickers"), ("markets", "n_markets"), ("resolved markets", "n_resolved"), ("events", "n_events"))


@query("meta_report", onward("meta_stats", " UNION ALL ".join(f"SELECT '{name}' AS metric, CAST({c} AS BIGINT) AS value, format('{{:,}}', CAST({c} AS BIGINT)) AS shown FROM rows_" for name, c in _META)))
def meta_report(spark, sf_dir):
    """The size of the data set, a row a measure, with the number as it is shown."""
    rows = meta_stats(spark, sf_dir).selectExpr(f"stack({len(_META)}, " + ", ".join(f"'{name}', cast({c} AS bigint)" for name, c in _META) + ") AS (metric, value)")
    return rows.withColumn("shown", F.format_number("value", 0))


@query("trade_audit", "SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity <= 0 OR l_quantity IS NULL) AS bad_count, count(*) FILTER (WHERE l_linestatus NOT IN ('O', 'F')) AS bad_side, count(*) FILTER (WHERE NOT (l_partkey BETWEEN 1 AND 1000000000)) AS bad_part, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated_lines, min(l_shipdate) AS first_ship FROM lineitem", views=False)
def trade_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("l_quantity <= 0 OR l_quantity IS NULL")).alias("bad_count"), F.count_if(~F.col("l_linestatus").isin("O", "F")).alias("bad_side"), F.count_if(~F.col("l_partkey").between(1, 1_000_000_000)).alias("bad_part"), (F.count(F.lit(1)) - F.countDistinct("l_orderkey", "l_linenumber")).alias("repeated_lines"), F.min("l_shipdate").alias("first_ship"))


@query("trade_cells", "SELECT ticker, yes_price, side, CAST(date_trunc('quarter', traded_on) AS DATE) AS quarter, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS units FROM trades GROUP BY ALL")
def trade_cells(spark, sf_dir):
    return adapter.trades(spark, sf_dir).groupBy("ticker", "yes_price", "side", F.expr("cast(date_trunc('quarter', traded_on) AS date)").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("units"))


@query("eligible_markets", "SELECT ticker, any_value(result) AS result, any_value(event_id) AS event_id, CAST(sum(cnt) AS BIGINT) AS units FROM joined GROUP BY ticker HAVING sum(cnt) >= 100")
def eligible_markets(spark, sf_dir):
    units = adapter.trades(spark, sf_dir).groupBy("ticker").agg(F.sum("cnt").alias("units")).where("units >= 100")
    return units.join(adapter.resolved(spark, sf_dir).select("ticker", "result", "event_id"), "ticker").select("ticker", "result", "event_id", "units")


@query("attrition", """SELECT 1 AS step, 'all' AS screen, count(*) AS n FROM markets UNION ALL SELECT 2, 'finalized', count(*) FROM markets WHERE status = 'finalized' UNION ALL SELECT 3, 'binary', count(*) FROM resolved
UNION ALL SELECT 4, 'traded', count(DISTINCT ticker) FROM joined UNION ALL SELECT 5, 'liquid', count(*) FROM (SELECT ticker FROM joined GROUP BY ticker HAVING sum(cnt) >= 100)""")
def attrition(spark, sf_dir):
    units = adapter.trades(spark, sf_dir).groupBy("ticker").agg(F.sum("cnt").alias("units"))
    m = adapter.markets(spark, sf_dir).join(units, "ticker", "left").selectExpr("status = 'finalized' AS fin", "status = 'finalized' AND result IN ('yes', 'no') AS bin", "coalesce(units, 0) AS units")
    row = m.agg(F.count(F.lit(1)).alias("c1"), F.count_if("fin").alias("c2"), F.count_if("bin").alias("c3"), F.count_if(F.expr("bin AND units > 0")).alias("c4"), F.count_if(F.expr("bin AND units >= 100")).alias("c5"))
    return row.selectExpr("stack(5, 1, 'all', c1, 2, 'finalized', c2, 3, 'binary', c3, 4, 'traded', c4, 5, 'liquid', c5) AS (step, screen, n)")


@query("category_roles", """, s AS (SELECT k.segment, p.event_id, p.role, sum(cnt * (100 * won - price)) * 1.0 / sum(cnt) AS m, sum(cnt) AS w FROM positions p JOIN customers k USING (event_id) GROUP BY ALL)
SELECT segment, role, round(sum(m * w) / sum(w), 8) AS weighted_mean, round(avg(m), 8) AS mean_of_means, count(*) AS events FROM s GROUP BY segment, role""")
def category_roles(spark, sf_dir):
    won = F.expr("100 * cast(side = result AS int) - CASE WHEN side = 'yes' THEN yes_price ELSE no_price END")
    e = joined(spark, sf_dir).groupBy("event_id").agg((F.sum(F.col("cnt") * won) * F.lit(1.0) / F.sum("cnt")).alias("m"), F.sum("cnt").alias("w"))  # a maker has what the taker loses
    e = e.selectExpr("event_id", "w", "stack(2, 'taker', m, 'maker', -m) AS (role, m)")
    s = e.join(customers(spark, sf_dir).select("event_id", "segment"), "event_id").groupBy("segment", "role")
    return s.agg(F.expr("round(sum(m * w) / sum(w), 8)").alias("weighted_mean"), F.expr("round(avg(m), 8)").alias("mean_of_means"), F.count(F.lit(1)).alias("events"))


@query("orphan_trades", "SELECT count(*) AS orphans FROM trades t LEFT JOIN (SELECT ticker FROM markets WHERE result <> '') m USING (ticker) WHERE m.ticker IS NULL")
def orphan_trades(spark, sf_dir):
    return adapter.trades(spark, sf_dir).join(adapter.markets(spark, sf_dir).where("result <> ''"), "ticker", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


@query("semi_markets", "SELECT ticker, event_id, status FROM markets WHERE ticker IN (SELECT ticker FROM trades WHERE cnt >= 45)")
def semi_markets(spark, sf_dir):
    return adapter.markets(spark, sf_dir).join(adapter.trades(spark, sf_dir).where("cnt >= 45"), "ticker", "left_semi").select("ticker", "event_id", "status")


@query("duplicate_audit", "SELECT count(*) - count(DISTINCT ticker) AS duplicate_tickers, (SELECT count(*) - count(DISTINCT trade_id) FROM ticks) AS duplicate_ticks FROM markets")
def duplicate_audit(spark, sf_dir):
    m = adapter.markets(spark, sf_dir).agg((F.count(F.lit(1)) - F.countDistinct("ticker")).alias("duplicate_tickers"))
    return m.crossJoin(adapter.ticks(spark, sf_dir).agg((F.count(F.lit(1)) - F.countDistinct("trade_id")).alias("duplicate_ticks")))


def bucket_of(event, ticker):
    return portable_bucket(F.concat(F.lit("340:"), F.coalesce(event, ticker).cast("string")))


def split_of(event, ticker):
    """The split of an event: train (70), test (20), validation (10) by a portable hash."""
    b = bucket_of(event, ticker)
    return F.when(b < 70, "train").when(b < 90, "test").otherwise("validation")


def splits(spark, sf_dir):
    """Markets with the split of their event: an event's markets stay together."""
    m = adapter.markets(spark, sf_dir).withColumn("bucket", bucket_of(F.col("event_id"), F.col("ticker")))
    return m.withColumn("split", F.when(F.col("bucket") < 70, "train").when(F.col("bucket") < 90, "test").otherwise("validation"))


_SPLIT = """, split AS (SELECT *, CAST(CAST('0x' || substr(md5('340:' || coalesce(event_id, ticker)), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM markets),
named AS (SELECT *, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 90 THEN 'test' ELSE 'validation' END AS split FROM split) """


@query("event_hash_split", _SPLIT + "SELECT ticker, bucket, split FROM named")
def event_hash_split(spark, sf_dir):
    return splits(spark, sf_dir).select("ticker", "bucket", "split")


@query("leakage_check", _SPLIT + "SELECT count(*) AS leaking FROM (SELECT event_id FROM named GROUP BY event_id HAVING count(DISTINCT split) > 1)")
def leakage_check(spark, sf_dir):
    return splits(spark, sf_dir).groupBy("event_id").agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("leaking"))


@query("split_counts", _SPLIT + "SELECT split, count(*) AS n_markets, count(DISTINCT event_id) AS n_events, 100.0 * count(*) / sum(count(*)) OVER () AS share FROM named GROUP BY split")
def split_counts(spark, sf_dir):
    s = splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_markets"), F.countDistinct("event_id").alias("n_events"))
    return s.withColumn("share", F.lit(100.0) * F.col("n_markets") / F.sum("n_markets").over(Window.partitionBy()))


@query("stable_sample", "SELECT ticker, sha256('42:' || ticker) AS k FROM markets ORDER BY k LIMIT 200")
def stable_sample(spark, sf_dir):
    return adapter.markets(spark, sf_dir).select("ticker", seeded_order(42, F.col("ticker")).alias("k")).orderBy("k").limit(200)


@query("topk_markets", ", u AS (SELECT ticker, sum(cnt) AS units FROM trades GROUP BY ticker) SELECT ticker, CAST(units AS BIGINT) AS units FROM u ORDER BY units DESC, ticker LIMIT 25")
def topk_markets(spark, sf_dir):
    return adapter.trades(spark, sf_dir).groupBy("ticker").agg(F.sum("cnt").alias("units")).orderBy(F.desc("units"), "ticker").limit(25)


@query("top_two_per_event", ", r AS (SELECT event_id, ticker, volume, row_number() OVER (PARTITION BY event_id ORDER BY volume DESC, ticker) AS rn, count(*) OVER (PARTITION BY event_id) AS n FROM markets) SELECT event_id, ticker, rn, n FROM r WHERE rn <= 2")
def top_two_per_event(spark, sf_dir):
    own = Window.partitionBy("event_id")
    m = adapter.markets(spark, sf_dir).withColumns({"n": F.count(F.lit(1)).over(own), "rn": F.row_number().over(own.orderBy(F.desc("volume"), "ticker")).cast("long")})
    return m.where("rn <= 2").select("event_id", "ticker", "rn", "n")


@query("every_second_day", ", d AS (SELECT CAST(ts AS DATE) AS dy, count(*) AS n FROM ticks GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY dy) AS rn FROM d) SELECT dy, n FROM r WHERE rn % 2 = 1")
def every_second_day(spark, sf_dir):
    d = adapter.ticks(spark, sf_dir).groupBy(F.expr("cast(ts AS date)").alias("dy")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("rn", F.row_number().over(Window.orderBy("dy"))).where("rn % 2 = 1").select("dy", "n")  # days, not trades


@query("cross_tab", "SELECT direction, CAST(sum(cnt) FILTER (won = 1) AS BIGINT) AS won, CAST(sum(cnt) FILTER (won = 0) AS BIGINT) AS lost FROM positions GROUP BY direction")
def cross_tab(spark, sf_dir):
    p = positions(spark, sf_dir).groupBy("direction").pivot("won", [1, 0]).agg(F.sum("contracts"))
    return p.select("direction", F.col("1").alias("won"), F.col("0").alias("lost"))


@query("key_union", "SELECT DISTINCT yes_price AS price FROM trades UNION SELECT DISTINCT price FROM ticks")
def key_union(spark, sf_dir):
    return adapter.trades(spark, sf_dir).select(F.col("yes_price").alias("price")).distinct().union(adapter.ticks(spark, sf_dir).select("price").distinct()).distinct()


# --- chain-style fills ---------------------------------------------------------------------------------------------

_FILLS = """, fills AS (SELECT event_id AS block, CASE WHEN event_id % 2 = 0 THEN '0' ELSE 'tok' || user_id % 40 END AS maker_asset, CASE WHEN event_id % 2 = 0 THEN 'tok' || user_id % 40 ELSE '0' END AS taker_asset,
  CASE WHEN event_id % 2 = 0 THEN 1 + event_id * 37 % 990 ELSE 1000 END AS maker_amount, CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 1 + event_id * 37 % 990 END AS taker_amount FROM events WHERE event_type IN ('purchase', 'signup')),
pools AS (SELECT event_id AS block, upper('0xAB' || user_id % 40) AS pool, CAST(1 + event_id * 41 % 990 AS VARCHAR) AS amount, '1000' AS outcome_tokens, event_id % 2 AS outcome FROM events WHERE event_type = 'click'),
tokens AS (SELECT 'tok' || k AS token, '0xab' || k AS pool, CASE WHEN k % 3 = 0 THEN '["0.995","0.005"]' WHEN k % 3 = 1 THEN '["0.001","0.999"]' ELSE 'broken' END AS prices FROM (SELECT range AS k FROM range(0, 40))),
known AS (SELECT token, pool, CAST(prices->>0 AS DOUBLE) > 0.99 AS won FROM tokens WHERE prices <> 'broken'),
sides AS (
  SELECT CAST(round(100.0 * CASE WHEN maker_asset = '0' THEN maker_amount ELSE taker_amount END / CASE WHEN maker_asset = '0' THEN taker_amount ELSE maker_amount END) AS INTEGER) AS price, won FROM fills JOIN known ON token = CASE WHEN maker_asset = '0' THEN taker_asset ELSE maker_asset END
  UNION ALL SELECT CAST(round(100.0 * CAST(amount AS DOUBLE) / CAST(outcome_tokens AS DOUBLE)) AS INTEGER), CASE WHEN outcome = 0 THEN won ELSE NOT won END FROM pools p JOIN known k ON lower(p.pool) = k.pool),
both_sides AS (SELECT price, won FROM sides UNION ALL SELECT 100 - price, NOT won FROM sides)
"""


def fills(spark, sf_dir):
    """Order-book fills and pool trades of the event stream, resolved by JSON outcome prices; both sides by one stack()."""
    e = table(spark, sf_dir, "events")
    book = e.where(F.col("event_type").isin("purchase", "signup")).selectExpr("CASE WHEN event_id % 2 = 0 THEN '0' ELSE concat('tok', user_id % 40) END AS maker_asset", "CASE WHEN event_id % 2 = 0 THEN concat('tok', user_id % 40) ELSE '0' END AS taker_asset", "CASE WHEN event_id % 2 = 0 THEN 1 + event_id * 37 % 990 ELSE 1000 END AS maker_amount", "CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 1 + event_id * 37 % 990 END AS taker_amount")
    pools = e.where("event_type = 'click'").selectExpr("upper(concat('0xAB', user_id % 40)) AS pool", "cast(1 + event_id * 41 % 990 AS string) AS amount", "'1000' AS outcome_tokens", "event_id % 2 AS outcome")
    tokens = spark.range(40).selectExpr("concat('tok', id) AS token", "concat('0xab', id) AS pool", "CASE WHEN id % 3 = 0 THEN '[\"0.995\",\"0.005\"]' WHEN id % 3 = 1 THEN '[\"0.001\",\"0.999\"]' ELSE 'broken' END AS prices")
    p = F.from_json("prices", "array<string>")
    yes, no = p[0].try_cast("double"), p[1].try_cast("double")
    known = tokens.where(F.size(p) == 2).select("token", "pool", F.when((yes > 0.99) & (no < 0.01), True).when((yes < 0.01) & (no > 0.99), False).alias("won")).where("won IS NOT NULL")
    known = F.broadcast(known)  # 40 tokens at most
    a = book.withColumn("token", F.expr("CASE WHEN maker_asset = '0' THEN taker_asset ELSE maker_asset END")).join(known, "token").selectExpr("cast(round(100d * CASE WHEN maker_asset = '0' THEN maker_amount ELSE taker_amount END / CASE WHEN maker_asset = '0' THEN taker_amount ELSE maker_amount END) AS int) AS price", "won")
    b = pools.withColumn("pool", F.lower("pool")).join(known, "pool").selectExpr("cast(round(100d * cast(amount AS double) / cast(outcome_tokens AS double)) AS int) AS price", "CASE WHEN outcome = 0 THEN won ELSE NOT won END AS won")
    return a.unionByName(b).selectExpr("stack(2, price, won, 100 - price, NOT won) AS (price, won)")


@query("ctf_win_rate", _FILLS + "SELECT price, count(*) AS total_trades, CAST(sum(won::INTEGER) AS BIGINT) AS wins, 100.0 * sum(won::INTEGER) / count(*) AS win_rate FROM both_sides WHERE price BETWEEN 1 AND 99 GROUP BY price")
def ctf_win_rate(spark, sf_dir):
    return fills(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price").agg(F.count(F.lit(1)).alias("total_trades"), F.count_if("won").alias("wins")).withColumn("win_rate", F.lit(100.0) * F.col("wins") / F.col("total_trades"))


@query("chain_calibration_by_bucket", _FILLS + """SELECT CAST(floor(price / 10.0) * 10 AS INTEGER) AS bucket_low, count(*) AS total, CAST(sum(won::INTEGER) AS BIGINT) AS wins, CAST(sum(price) AS BIGINT) / (100.0 * count(*)) AS mean_predicted, sum(won::INTEGER) * 1.0 / count(*) AS actual_rate
FROM both_sides WHERE price BETWEEN 1 AND 99 GROUP BY 1""")
def chain_calibration_by_bucket(spark, sf_dir):
    b = fills(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy(decile(F.col("price")).alias("bucket_low"))
    b = b.agg(F.count(F.lit(1)).alias("total"), F.count_if("won").alias("wins"), F.sum("price").alias("p"))
    return b.selectExpr("bucket_low", "total", "wins", "p / (100d * total) AS mean_predicted", "wins * 1d / total AS actual_rate")


@query("chain_volume", """, looked AS (SELECT c_custkey AS pool, CASE WHEN c_custkey % 4 = 0 THEN 'DAI' ELSE 'USDC' END AS collateral FROM customer), b AS (SELECT event_id // 1000 AS bucket, min(ts) AS t FROM events GROUP BY 1),
f AS (SELECT event_id // 1000 AS bucket, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' OR (event_type = 'click' AND user_id IN (SELECT pool FROM looked WHERE collateral = 'USDC'))),
q AS (SELECT CAST(date_trunc('quarter', t) AS DATE) AS quarter, sum(cents) AS c, count(*) AS n FROM f JOIN b USING (bucket) GROUP BY 1)
SELECT quarter, CAST(c AS BIGINT) AS volume_cents, n, 'Q' || quarter(quarter) || ' ''' || substr(CAST(year(quarter) AS VARCHAR), 3) AS label FROM q""")
def chain_volume(spark, sf_dir):
    """Order-book fills, and those pool trades whose pool a lookup says is in USDC, by the quarter of their block bucket; buckets get their time once summed."""
    looked = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "CASE WHEN c_custkey % 4 = 0 THEN 'DAI' ELSE 'USDC' END AS collateral").where("collateral = 'USDC'")
    e = table(spark, sf_dir, "events").selectExpr("event_id div 1000 AS bucket", "event_type", "user_id", "ts", "cast(round(value * 100) AS bigint) AS cents")
    told = e.join(looked.select("user_id", F.lit(True).alias("usdc")), "user_id", "left")
    taken = F.expr("event_type = 'purchase' OR (event_type = 'click' AND coalesce(usdc, false))")
    by = told.groupBy("bucket").agg(F.min("ts").alias("t"), F.sum(F.when(taken, F.col("cents"))).alias("c"), F.count_if(taken).alias("n")).where("n > 0")
    q = by.groupBy(F.expr("cast(date_trunc('quarter', t) AS date)").alias("quarter")).agg(F.sum("c").alias("volume_cents"), F.sum("n").alias("n"))
    return q.withColumn("label", quarter_label(F.col("quarter")))


@query("malformed_trades", """, raw AS (SELECT *, l_partkey % 101 AS yes, 99 + l_partkey % 2 - l_partkey % 101 AS no FROM lineitem)
SELECT count(*) AS trades, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS without_id, count(*) FILTER (WHERE l_linestatus IS NULL OR l_linestatus NOT IN ('O', 'F')) AS odd_side, count(*) FILTER (WHERE yes NOT BETWEEN 1 AND 99 OR no NOT BETWEEN 1 AND 99) AS odd_price,
  count(*) FILTER (WHERE yes + no <> 100) AS odd_sum, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS odd_count,
  count(*) FILTER (WHERE yes BETWEEN 1 AND 99 AND no BETWEEN 1 AND 99 AND yes + no = 100 AND l_linestatus IN ('O', 'F') AND l_quantity > 0 AND l_shipdate IS NOT NULL) AS valid FROM raw""")
def malformed_trades(spark, sf_dir):
    """Trades whose raw fields break a rule, by rule, and how many break none: ids, side, prices, their sum of 100, count, time.

    The raw prices are made of the part's key so that some break a rule: 0 and 100 occur, and every other sum is 99.
    """
    t = table(spark, sf_dir, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) AS trade_id", "cast(l_orderkey AS string) AS ticker", "CASE l_linestatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'no' END AS taker_side",
        "l_partkey % 101 AS yes_price", "99 + l_partkey % 2 - l_partkey % 101 AS no_price", "l_quantity AS `count`", "l_shipdate AS created_time")
    return t.agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("trade_id").isNull()).alias("without_id"), F.count_if(F.col("taker_side").isNull()).alias("odd_side"), F.count_if(~(F.col("yes_price").between(1, 99) & F.col("no_price").between(1, 99))).alias("odd_price"),
        F.count_if(F.col("yes_price") + F.col("no_price") != 100).alias("odd_sum"), F.count_if(~F.coalesce(F.col("count") > 0, F.lit(False))).alias("odd_count"), F.count_if(valid_trade()).alias("valid"),
    )


@query("block_volume", """, b AS (SELECT event_id // 1000 AS bucket, min(ts) AS t FROM events GROUP BY 1), f AS (SELECT event_id // 1000 AS bucket, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type IN ('purchase', 'click') OR event_id % 7 = 0)
SELECT CAST(date_trunc('week', t) AS DATE) AS week_start, CAST(sum(cents) AS BIGINT) AS volume_cents, count(*) AS n FROM f JOIN b USING (bucket) GROUP BY 1""")
def block_volume(spark, sf_dir):
    """Aggregated by block bucket before the bucket gets its time."""
    e = table(spark, sf_dir, "events").withColumn("bucket", F.expr("event_id div 1000"))
    b = e.groupBy("bucket").agg(F.min("ts").alias("t"))
    f = e.where("event_type IN ('purchase', 'click') OR event_id % 7 = 0").groupBy("bucket").agg(F.expr("sum(cast(round(value * 100) AS bigint))").alias("c"), F.count(F.lit(1)).alias("n"))
    return f.join(b, "bucket").groupBy(F.expr("cast(date_trunc('week', t) AS date)").alias("week_start")).agg(F.sum("c").alias("volume_cents"), F.sum("n").alias("n"))


@query("trades_per_block", """, a AS (SELECT event_id // 10 AS block, count(*) AS c FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT event_id // 10, count(*) FROM events WHERE event_type = 'purchase' GROUP BY 1),
blocks AS (SELECT event_id // 10 AS block, min(ts) AS t FROM events GROUP BY 1)
SELECT block, CAST(sum(c) AS BIGINT) AS trade_count, CAST(any_value(t) AS DATE) AS dy FROM a JOIN blocks USING (block) GROUP BY block""")
def trades_per_block(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("block", F.expr("event_id div 10"))
    by = e.groupBy("block").agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("trade_count"), F.expr("cast(min(ts) AS date)").alias("dy"))
    return by.where("trade_count > 0")


@query("block_interpolation", """, s AS (SELECT event_id AS block, CAST(epoch(ts) AS BIGINT) AS t FROM events WHERE event_id % 10 = 0), n AS (SELECT *, lead(block) OVER (ORDER BY block) AS nb, lead(t) OVER (ORDER BY block) AS nt FROM s)
SELECT block + k AS block, t + (nt - t) * k // (nb - block) AS t FROM (SELECT *, unnest(generate_series(0, nb - block - 1)) AS k FROM n WHERE nb IS NOT NULL) UNION ALL SELECT block, t FROM n WHERE nb IS NULL""")
def block_interpolation(spark, sf_dir):
    """Sampled blocks' times filled in linearly, up to the last sampled block itself. The sample before a block is found in ranges: a window over each, and the next range's first sample."""
    span = 10_000
    s = table(spark, sf_dir, "events").where("event_id % 10 = 0").selectExpr(f"event_id div {span} AS part", "struct(event_id AS block, cast(floor(unix_micros(cast(ts AS timestamp)) / 1e6 + 0.5) AS bigint) AS t) AS s")
    own = Window.partitionBy("part")
    firsts = s.select("part", F.min("s").over(own).alias("f")).distinct()  # from the same shuffle as the windows over each range
    after = firsts.withColumn("next", F.lead("f").over(Window.orderBy("part"))).select("part", "next")  # one row a range
    n = s.withColumn("n", F.lead("s").over(own.orderBy("s"))).join(after, "part", "left").withColumn("n", F.coalesce("n", "next")).select("s.block", "s.t", "n")
    return n.select("block", "t", "n", F.explode(F.expr("sequence(0L, coalesce(n.block - block - 1, 0L))")).alias("k")).selectExpr("block + k AS block", "t + coalesce((n.t - t) * k div (n.block - block), 0) AS t")


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type", views=False)
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@query("formatted_totals", ", s AS (SELECT r_name, CAST(sum(CAST(round(volume * 100) AS BIGINT)) AS BIGINT) AS c FROM markets JOIN customers USING (event_id) GROUP BY 1) SELECT r_name, c, printf('%.1fM', c / 1e6) AS shown, lower(trim(' ' || r_name || ' ')) || ':' || CAST(c % 100 AS VARCHAR) AS tag FROM s")
def formatted_totals(spark, sf_dir):
    s = adapter.markets(spark, sf_dir).join(customers(spark, sf_dir), "event_id").groupBy("r_name").agg(F.expr("sum(cast(round(volume * 100) AS bigint))").alias("c"))
    return s.selectExpr("r_name", "c", "format_string('%.1fM', c / 1e6d) AS shown", "concat(lower(trim(concat(' ', r_name, ' '))), ':', c % 100) AS tag")


@query("iso_times", "SELECT event_id, strftime(make_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events", views=False)
def iso_times(spark, sf_dir):
    """Unix seconds as ISO-8601 text, in UTC whatever the session's time zone."""
    seconds = table(spark, sf_dir, "events").selectExpr("event_id", "cast(floor(unix_micros(cast(ts AS timestamp)) / 1e6) AS bigint) AS s")
    return seconds.selectExpr("event_id", "date_format(convert_timezone(current_timezone(), 'UTC', cast(timestamp_seconds(s) AS timestamp_ntz)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS iso")


@query("case_insensitive_search", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'RING|^Blue b', 'i')", views=False)
def case_insensitive_search(spark, sf_dir, pattern: str = "RING|^Blue b"):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike(f"(?i){pattern}")).select("p_partkey", "p_name")


@query("bound_parameters", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_totalprice >= 100000.0 AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_orderstatus", views=False)
def bound_parameters(spark, sf_dir, least: float = 100000.0, before: str = "1997-01-01"):
    """Values reach the query as parameters, never as text of it."""
    text = "SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS keys FROM {orders} WHERE o_totalprice >= :least AND o_orderdate < cast(:before AS timestamp_ntz) GROUP BY o_orderstatus"
    return spark.sql(text, args={"least": least, "before": before}, orders=table(spark, sf_dir, "orders"))
