"""Screens, cohorts and their support, coverage, and counts of tail patterns."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.operators.guards import guarded, integrity
from calibra.operators.positions import joined, positions
from calibra.plans.base import query
from calibra.plans.market import _SPLIT, customers, eligible_markets, splits
from calibra.sources import adapter

_TRAIN = _SPLIT + ", tr AS (SELECT j.*, k.n_name AS family FROM joined j JOIN named s USING (ticker) JOIN customers k ON k.event_id = j.event_id WHERE s.split = 'train')"


def families(spark, sf_dir):
    """Resolved markets with split and family (the nation of the event's customer)."""
    s = splits(spark, sf_dir).where("status = 'finalized' AND result IN ('yes', 'no')").select("ticker", "event_id", "split", "result")
    return s.join(customers(spark, sf_dir).select("event_id", F.col("n_name").alias("family")), "event_id")


def train_cells(spark, sf_dir, *dims: str):
    """Contracts of training trades by family, YES price and outcome, and by ``dims``."""
    c = joined(spark, sf_dir).groupBy("ticker", "yes_price").agg(F.sum("cnt").alias("w"))
    return c.join(families(spark, sf_dir).where("split = 'train'"), "ticker").groupBy(*dims, "family", "yes_price", "result").agg(F.sum("w").alias("w"))


@query("metadata_screens", _SPLIT + """, m AS (SELECT s.*, event_ticker FROM named s LEFT JOIN customers USING (event_id))
SELECT split, count(*) AS input, count(*) FILTER (WHERE event_ticker NOT LIKE 'AUTO%' AND trim(event_ticker) <> '') AS retained FROM m GROUP BY split""")
def metadata_screens(spark, sf_dir):
    """Markets of each split before and after the screens (excluded ticker prefix, blank event). A repeated ticker, or an
    event in several splits, among the retained is an error."""
    m = splits(spark, sf_dir).join(customers(spark, sf_dir).select("event_id", "event_ticker"), "event_id", "left")
    fit = ~F.col("event_ticker").startswith("AUTO") & (F.trim("event_ticker") != "")
    faults = integrity(m.where(fit), "ticker", "event_id", "split")
    n = m.groupBy("split").agg(F.count(F.lit(1)).alias("input"), F.count_if(fit).alias("kept")).crossJoin(faults)  # three rows and one
    kept = guarded(F.col("kept"), F.col("repeated") > 0, "repeated tickers among the splits")
    return n.select("split", "input", guarded(kept, F.col("overlapping") > 0, "events in several splits").alias("retained"))


@query("cohort_support", _TRAIN + """, f AS (SELECT k.n_name AS family, r.ticker, r.event_id FROM resolved r JOIN named s USING (ticker) JOIN customers k ON k.event_id = r.event_id WHERE s.split = 'train')
SELECT family, count(DISTINCT ticker) AS contracts, count(DISTINCT event_id) AS events, count(DISTINCT ticker) >= 100 AND count(DISTINCT event_id) >= 20 AS supported FROM f GROUP BY family""")
def cohort_support(spark, sf_dir, contracts: int = 100, events: int = 20):
    """Resolved training contracts and events of each family; held-out rows never decide."""
    f = families(spark, sf_dir).where("split = 'train'").groupBy("family").agg(F.countDistinct("ticker").alias("contracts"), F.countDistinct("event_id").alias("events"))
    return f.withColumn("supported", (F.col("contracts") >= contracts) & (F.col("events") >= events))


@query("supported_cohorts", _SPLIT + """, f AS (SELECT k.n_name AS family, s.split, r.ticker, r.event_id FROM resolved r JOIN named s USING (ticker) JOIN customers k ON k.event_id = r.event_id)
SELECT family, split, count(*) AS n FROM f WHERE family IN (SELECT family FROM f WHERE split = 'train' GROUP BY family HAVING count(DISTINCT ticker) >= 100 AND count(DISTINCT event_id) >= 20) GROUP BY family, split""")
def supported_cohorts(spark, sf_dir):
    """Markets, by family and split, of the families with enough training support."""
    return families(spark, sf_dir).join(cohort_support(spark, sf_dir).where("supported"), "family", "left_semi").groupBy("family", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_coverage", _SPLIT + """, s AS (SELECT split, count(*) AS markets, count(*) FILTER (WHERE status = 'open') AS open_markets, count(*) FILTER (WHERE status = 'finalized') AS finalized FROM named GROUP BY split)
SELECT *, 100.0 * finalized / markets AS finalized_pct FROM s""")
def split_coverage(spark, sf_dir):
    s = splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("markets"), F.count_if(F.col("status") == "open").alias("open_markets"), F.count_if(F.col("status") == "finalized").alias("finalized"))
    return s.withColumn("finalized_pct", F.lit(100.0) * F.col("finalized") / F.col("markets"))


@query("category_volume", """, e AS (SELECT ticker, any_value(event_id) AS event_id FROM joined GROUP BY ticker HAVING sum(cnt) >= 100),
g AS (SELECT segment, CAST(sum(CAST(round(m.volume * 100) AS BIGINT)) AS BIGINT) AS notional_cents, count(*) AS n_markets FROM e JOIN markets m USING (ticker) JOIN customers k ON k.event_id = e.event_id GROUP BY segment)
SELECT *, 100.0 * notional_cents / sum(notional_cents) OVER () AS share FROM g""")
def category_volume(spark, sf_dir):
    """Notional value and number of eligible markets by category."""
    e = eligible_markets(spark, sf_dir).select("ticker", "event_id").join(adapter.markets(spark, sf_dir).select("ticker", "volume"), "ticker")
    g = e.join(customers(spark, sf_dir).select("event_id", "segment"), "event_id").groupBy("segment").agg(F.sum(F.expr("cast(round(volume * 100) AS bigint)")).alias("notional_cents"), F.count(F.lit(1)).alias("n_markets"))
    return g.withColumn("share", F.lit(100.0) * F.col("notional_cents") / F.sum("notional_cents").over(Window.partitionBy()))  # a row a category


@query("price_coverage", "SELECT CAST((price - 1) // 10 AS INTEGER) AS decile, count(*) AS n FROM positions GROUP BY 1")
def price_coverage(spark, sf_dir):
    return positions(spark, sf_dir).groupBy(F.expr("cast((price - 1) div 10 AS int)").alias("decile")).agg(F.sum("n").alias("n"))


@query("training_calibration", _TRAIN + """SELECT CAST((yes_price - 1) // 10 AS INTEGER) AS bucket, CAST(sum(cnt) AS BIGINT) AS n, sum(cnt * yes_price) / (100.0 * sum(cnt)) AS mean_price, sum(cnt * CAST(result = 'yes' AS INTEGER)) * 1.0 / sum(cnt) AS win_rate FROM tr GROUP BY 1""")
def training_calibration(spark, sf_dir):
    c = train_cells(spark, sf_dir).groupBy(F.expr("cast((yes_price - 1) div 10 AS int)").alias("bucket"))
    return c.agg(F.sum("w").alias("n"), F.expr("sum(w * yes_price) / (100d * sum(w))").alias("mean_price"), F.expr("sum(w * cast(result = 'yes' AS int)) * 1d / sum(w)").alias("win_rate"))


@query("family_band_heat", _TRAIN + """, top AS (SELECT family FROM tr GROUP BY family ORDER BY sum(cnt) DESC, family LIMIT 8)
SELECT family, CAST((yes_price - 1) // 10 AS INTEGER) AS bucket, CAST(sum(cnt) AS BIGINT) AS n, count(DISTINCT event_id) AS events,
CASE WHEN count(DISTINCT event_id) >= 5 THEN sum(cnt * (100 * CAST(result = 'yes' AS INTEGER) - yes_price)) * 1.0 / sum(cnt) END AS deviation_pp FROM tr WHERE family IN (SELECT family FROM top) GROUP BY ALL""")
def family_band_heat(spark, sf_dir, top: int = 8, least: int = 5):
    """Mean deviation by price band of the families with most training contracts; bands of under five events have none."""
    c = train_cells(spark, sf_dir, "event_id").groupBy("family", F.expr("cast((yes_price - 1) div 10 AS int)").alias("bucket")).agg(F.sum("w").alias("n"), F.countDistinct("event_id").alias("events"), F.expr("sum(w * (100 * cast(result = 'yes' AS int) - yes_price))").alias("d"))
    ranked = c.withColumn("total", F.sum("n").over(Window.partitionBy("family"))).withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("total"), "family")))  # ten rows a family
    return ranked.where(F.col("place") <= top).select("family", "bucket", "n", "events", F.when(F.col("events") >= least, F.expr("d * 1d / n")).alias("deviation_pp"))


_RATES = ", r AS (SELECT price, count(*) AS n, sum(won) AS w FROM positions GROUP BY price), d AS (SELECT price, direction, count(*) AS n, sum(won) AS w FROM positions GROUP BY ALL)"


@query("tail_patterns", _RATES + """SELECT (SELECT count(*) FROM d a JOIN d b USING (price) WHERE a.direction = 'no' AND b.direction = 'yes' AND a.w * b.n > b.w * a.n) AS no_better,
count(*) FILTER (WHERE price < 20 AND 100 * w < n * price) AS longshots_below, count(*) FILTER (WHERE price > 80 AND 100 * w > n * price) AS favourites_above FROM r""")
def tail_patterns(spark, sf_dir):
    """Prices at which NO returns more than YES, longshots win less than priced, favourites more. Compared as integers."""
    of = lambda d, x: F.sum(F.when(F.col("direction") == d, F.expr(x)))
    p = positions(spark, sf_dir).groupBy("price").agg(of("yes", "n").alias("ny"), of("yes", "n * won").alias("wy"), of("no", "n").alias("nn"), of("no", "n * won").alias("wn"), F.sum("n").alias("n"), F.expr("sum(n * won)").alias("w"))
    return p.agg(F.count_if(F.expr("wn * ny > wy * nn")).alias("no_better"), F.count_if(F.expr("price < 20 AND 100 * w < n * price")).alias("longshots_below"), F.count_if(F.expr("price > 80 AND 100 * w > n * price")).alias("favourites_above"))


# The published full-sample results that a run is set beside.
PUBLISHED = [
    ("win rate at 5 cents (%)", 4.18),
    ("mispricing at 5 cents (pp)", -0.82),
    ("mean gross return at 5 cents (%)", -16.4),
    ("win rate at 95 cents (%)", 95.83),
    ("mean gross return of YES at 1 cent (%)", -41.0),
    ("mean gross return of NO at 1 cent (%)", 23.0),
    ("mean mispricing of takers (pp)", -1.12),
]
_MEASURES = [
    "100.0 * sum(n * won) FILTER (WHERE price = 5) / sum(n) FILTER (WHERE price = 5)",
    "1.0 * sum(n * (100 * won - price)) FILTER (WHERE price = 5) / sum(n) FILTER (WHERE price = 5)",
    "20.0 * sum(n * (100 * won - price)) FILTER (WHERE price = 5) / sum(n) FILTER (WHERE price = 5)",
    "100.0 * sum(n * won) FILTER (WHERE price = 95) / sum(n) FILTER (WHERE price = 95)",
    "100.0 * sum(n * (100 * won - price)) FILTER (WHERE price = 1 AND direction = 'yes') / sum(n) FILTER (WHERE price = 1 AND direction = 'yes')",
    "100.0 * sum(n * (100 * won - price)) FILTER (WHERE price = 1 AND direction = 'no') / sum(n) FILTER (WHERE price = 1 AND direction = 'no')",
    "1.0 * sum(n * (100 * won - price)) FILTER (WHERE role = 'taker') / sum(n) FILTER (WHERE role = 'taker')",
]


@query("published_comparison", ", c AS (SELECT price, direction, role, won, count(*) AS n FROM positions GROUP BY ALL) " + " UNION ALL ".join(f"SELECT '{name}' AS quantity, CAST({value} AS DOUBLE) AS published, round(CAST({m} AS DOUBLE), 8) AS measured FROM c" for (name, value), m in zip(PUBLISHED, _MEASURES, strict=True)))
def published_comparison(spark, sf_dir):
    """Published values beside those of these trades, all of them aggregates of one pass."""
    row = positions(spark, sf_dir).agg(*[F.expr(f"round(cast({m.replace('0 * sum', '0D * sum')} AS double), 8)").alias(f"m{k}") for k, m in enumerate(_MEASURES)])
    return row.selectExpr(f"stack({len(PUBLISHED)}, " + ", ".join(f"'{name}', {value}D, m{k}" for k, (name, value) in enumerate(PUBLISHED)) + ") AS (quantity, published, measured)")


@query("brier_top_markets", """, u AS (SELECT ticker, row_number() OVER (ORDER BY sum(cnt) DESC, ticker) <= 25 AS top FROM joined GROUP BY ticker),
s AS (SELECT CASE WHEN top THEN 'top' ELSE 'rest' END AS scope, sum(cnt) AS w, sum(cnt * (100 * CAST(result = 'yes' AS INTEGER) - yes_price) * (100 * CAST(result = 'yes' AS INTEGER) - yes_price)) AS sq FROM joined JOIN u USING (ticker) GROUP BY 1),
a AS (SELECT scope, w, sq FROM s UNION ALL SELECT 'all', sum(w), sum(sq) FROM s) SELECT scope, CAST(w AS BIGINT) AS w, sq / (10000.0 * w) AS brier FROM a""")
def brier_top_markets(spark, sf_dir, k: int = 25):
    """Brier score of the k most traded markets, of the rest, and of all; the two parts add up to all."""
    m = joined(spark, sf_dir).groupBy("ticker").agg(F.sum("cnt").alias("w"), F.expr("cast(sum(cnt * (100 * cast(result = 'yes' AS int) - yes_price) * (100 * cast(result = 'yes' AS int) - yes_price)) AS bigint)").alias("sq"))
    top = m.orderBy(F.desc("w"), "ticker").limit(k).agg(F.sum("w").alias("tw"), F.sum("sq").alias("tsq"))
    both = m.agg(F.sum("w").alias("w"), F.sum("sq").alias("sq")).crossJoin(top)  # one row each, of the same aggregate
    s = both.selectExpr("stack(3, 'top', tw, tsq, 'rest', w - tw, sq - tsq, 'all', w, sq) AS (scope, w, sq)").where("w > 0")
    return s.selectExpr("scope", "w", "sq / (10000d * w) AS brier")
