"""Results by time and by size."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.functions.buckets import log_bin
from calibra.operators.positions import cells, dual, joined, positions
from calibra.plans.base import query
from calibra.sources import adapter

QUARTER = "cast(date_trunc('quarter', traded_on) AS date)"


@query("volume_over_time", "SELECT CAST(date_trunc('quarter', traded_on) AS DATE) AS quarter, CAST(sum(cnt) AS BIGINT) AS volume_usd, year(traded_on) || ' Q' || quarter(traded_on) AS label FROM trades GROUP BY 1, 3")
def volume_over_time(spark, sf_dir):
    t = adapter.trades(spark, sf_dir).groupBy(F.expr(QUARTER).alias("quarter")).agg(F.sum("cnt").alias("volume_usd"))
    return t.withColumn("label", F.expr("concat(year(quarter), ' Q', quarter(quarter))"))


_BAND = "CASE " + " ".join(f"WHEN price BETWEEN {10 * k + 1} AND {10 * k + 10} THEN '{10 * k + 1:02d}-{10 * k + 10}'" for k in range(10)) + " END"


@query("longshot_volume_share", f""", q AS (SELECT CAST(date_trunc('quarter', traded_on) AS DATE) AS quarter, CASE WHEN side = 'yes' THEN yes_price ELSE no_price END AS price, cnt FROM trades)
SELECT quarter, CAST(sum(cnt * price) FILTER (price BETWEEN 1 AND 20) AS BIGINT) AS longshot_cents, CAST(sum(cnt * price) AS BIGINT) AS total_cents, 100.0 * sum(cnt * price) FILTER (price BETWEEN 1 AND 20) / sum(cnt * price) AS share, count(*) AS n FROM q GROUP BY quarter""")
def longshot_volume_share(spark, sf_dir):
    q = adapter.trades(spark, sf_dir).selectExpr(f"{QUARTER} AS quarter", "CASE WHEN side = 'yes' THEN yes_price ELSE no_price END AS price", "cnt").groupBy("quarter")
    q = q.agg(F.expr("sum(CASE WHEN price BETWEEN 1 AND 20 THEN cnt * price END)").alias("longshot_cents"), F.expr("sum(cnt * price)").alias("total_cents"), F.count(F.lit(1)).alias("n"))
    return q.withColumn("share", F.lit(100.0) * F.col("longshot_cents") / F.col("total_cents"))


@query("price_band_pivot", f""", q AS (SELECT CAST(date_trunc('quarter', traded_on) AS DATE) AS quarter, {_BAND} AS band, sum(cnt) AS c FROM (SELECT *, yes_price AS price FROM trades) GROUP BY 1, 2)
SELECT quarter, """ + ", ".join(f"CAST(coalesce(sum(c) FILTER (band = '{10 * k + 1:02d}-{10 * k + 10}'), 0) AS BIGINT) AS b{k}" for k in range(10)) + " FROM q GROUP BY quarter")
def price_band_pivot(spark, sf_dir):
    q = adapter.trades(spark, sf_dir).selectExpr(f"{QUARTER} AS quarter", "yes_price AS price", "cnt").withColumn("band", F.expr(_BAND))
    names = [f"{10 * k + 1:02d}-{10 * k + 10}" for k in range(10)]
    wide = q.groupBy("quarter").pivot("band", names).agg(F.sum("cnt")).na.fill(0)
    return wide.select("quarter", *[F.col(f"`{b}`").alias(f"b{k}") for k, b in enumerate(names)])


@query("maker_taker_gap_over_time", """, g AS (SELECT CAST(date_trunc('quarter', traded_on) AS DATE) AS quarter, role, count(*) AS n, sum(100 * won - price) / (1.0 * count(*)) AS ret, sum(cnt * price) / 100.0 AS volume FROM positions GROUP BY 1, 2 HAVING count(*) >= 100)
SELECT t.quarter, round(t.ret, 8) AS taker_return, round(m.ret, 8) AS maker_return, round(m.ret - t.ret, 8) AS gap_pp, t.n, round(t.volume + m.volume, 2) AS volume FROM g t JOIN g m ON t.quarter = m.quarter AND t.role = 'taker' AND m.role = 'maker'""")
def maker_taker_gap_over_time(spark, sf_dir):
    t = joined(spark, sf_dir).withColumn("quarter", F.expr(QUARTER))  # before cells are made, so that a task has few of them
    p = dual(cells(t, "quarter"), "quarter").groupBy("quarter", "role").agg(F.sum("n").alias("n"), F.expr("sum(n * (100 * won - price))").alias("cents"), F.expr("sum(contracts * price)").alias("volume"))
    wide = p.where("n >= 100").groupBy("quarter").pivot("role", ["taker", "maker"]).agg(F.first("n").alias("n"), F.first("cents").alias("c"), F.first("volume").alias("v"))
    wide = wide.dropna(subset=["taker_n", "maker_n"]).selectExpr("*", "taker_c / (1d * taker_n) AS t", "maker_c / (1d * maker_n) AS m")
    return wide.selectExpr("quarter", "round(t, 8) AS taker_return", "round(m, 8) AS maker_return", "round(m - t, 8) AS gap_pp", "taker_n AS n", "round(taker_v / 100d + maker_v / 100d, 2) AS volume")


@query("returns_by_hour", """, h AS (SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, cnt, price, CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END AS won FROM ticks)
SELECT hour_of_day, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS contracts, round(avg(won * 1.0), 8) AS win_rate, round(avg(price / 100.0), 8) AS implied, round(avg(won - price / 100.0), 8) AS excess, round(var_samp(won - price / 100.0), 8) AS var_samp, round(1.96 * sqrt(var_samp(won - price / 100.0) / count(*)), 8) AS ci FROM h GROUP BY 1""")
def returns_by_hour(spark, sf_dir):
    h = adapter.ticks(spark, sf_dir).selectExpr("hour(ts) AS hour_of_day", "cnt", "price", "CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END AS won").selectExpr("*", "won - price / 100d AS x").groupBy("hour_of_day")
    return h.agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("contracts"), F.expr("round(avg(won * 1d), 8)").alias("win_rate"), F.expr("round(avg(price / 100d), 8)").alias("implied"), F.expr("round(avg(x), 8)").alias("excess"), F.expr("round(var_samp(x), 8)").alias("var_samp"), F.expr("round(1.96d * sqrt(var_samp(x) / count(1)), 8)").alias("ci"))


@query("vwap_by_hour", """SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, sum(cnt * price) * 1.0 / sum(cnt) AS vwap, CAST(sum(cnt) AS BIGINT) AS contracts, count(*) AS n, round(avg(price * 1.0), 8) AS mean_price, round(stddev_samp(price * 1.0), 8) AS std_price, round(stddev_samp(price * 1.0) / sqrt(count(*)), 8) AS se, round(1.96 * stddev_samp(price * 1.0) / sqrt(count(*)), 8) AS ci FROM ticks GROUP BY 1""")
def vwap_by_hour(spark, sf_dir):
    return adapter.ticks(spark, sf_dir).groupBy(F.hour("ts").alias("hour_of_day")).agg(F.expr("sum(cnt * price) * 1d / sum(cnt)").alias("vwap"), F.sum("cnt").alias("contracts"), F.count(F.lit(1)).alias("n"), F.expr("round(avg(price * 1d), 8)").alias("mean_price"), F.expr("round(stddev_samp(price * 1d), 8)").alias("std_price"), F.expr("round(stddev_samp(price * 1d) / sqrt(count(1)), 8)").alias("se"), F.expr("round(1.96d * stddev_samp(price * 1d) / sqrt(count(1)), 8)").alias("ci"))


@query("local_hour_volume", "SELECT CAST(hour(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) AS INTEGER) AS local_hour, CAST(sum(cnt) AS BIGINT) AS contracts FROM ticks GROUP BY 1")
def local_hour_volume(spark, sf_dir):
    return adapter.ticks(spark, sf_dir).groupBy(F.hour(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")).alias("local_hour")).agg(F.sum("cnt").alias("contracts"))


@query("trade_size_by_role", """, s AS (SELECT role, cnt * price AS cents, cnt FROM positions)
SELECT role, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total_cents, sum(cents) / (100.0 * count(*)) AS mean_usd, round(stddev_pop(cents / 100.0), 6) AS std_usd, median(cents / 100.0) AS median_usd, quantile_cont(cents / 100.0, 0.25) AS p25, quantile_cont(cents / 100.0, 0.75) AS p75, quantile_cont(cents / 100.0, 0.9) AS p90, round(quantile_cont(cents / 100.0, 0.95), 6) AS p95, median(CAST(cnt AS DOUBLE)) AS median_contracts FROM s GROUP BY role""")
def trade_size_by_role(spark, sf_dir):
    """Exact percentiles over (value, frequency) pairs, so that map-side aggregation leaves few rows to the percentile."""
    s = joined(spark, sf_dir).selectExpr("cnt", "stack(2, 'taker', CASE WHEN side = 'yes' THEN yes_price ELSE no_price END, 'maker', CASE WHEN side = 'yes' THEN no_price ELSE yes_price END) AS (role, price)")
    f = s.groupBy("role", "cnt", "price").agg(F.count(F.lit(1)).alias("f")).selectExpr("role", "cnt", "cnt * price AS cents", "f")
    pct = lambda p: F.expr(f"percentile(cents / 100d, {p}d, f)")
    out = f.groupBy("role").agg(F.sum("f").alias("n"), F.expr("sum(cents * f)").alias("total_cents"), F.expr("sum(f * cents * 1d / 100d * cents / 100d)").alias("sq"), pct(0.5).alias("median_usd"), pct(0.25).alias("p25"), pct(0.75).alias("p75"), pct(0.9).alias("p90"), F.round(pct(0.95), 6).alias("p95"), F.expr("percentile(cnt * 1d, 0.5d, f)").alias("median_contracts"))
    return out.selectExpr("role", "n", "total_cents", "total_cents / (100d * n) AS mean_usd", "round(sqrt(sq / n - pow(total_cents / (100d * n), 2d)), 6) AS std_usd", "median_usd", "p25", "p75", "p90", "p95", "median_contracts")


@query("win_rate_by_trade_size", """, s AS (SELECT round(pow(10.0, floor(log10(greatest(cnt * price / 100.0, 0.01)) * 4) / 4.0), 8) AS size_bin, won, price, won - price / 100.0 AS x, cnt * price AS cents FROM positions)
SELECT size_bin, count(*) AS n, CAST(sum(cents) AS BIGINT) AS volume_cents, round(avg(won * 1.0), 8) AS win_rate, round(avg(price / 100.0), 8) AS expected, round(avg(x), 8) AS excess, round(var_samp(x), 8) AS var_samp, round(sqrt(var_samp(x) / count(*)), 8) AS se, round(1.96 * sqrt(var_samp(x) / count(*)), 8) AS ci FROM s GROUP BY size_bin HAVING count(*) >= 10""")
def win_rate_by_trade_size(spark, sf_dir):
    s = joined(spark, sf_dir).selectExpr("cnt", "stack(2, CASE WHEN side = 'yes' THEN yes_price ELSE no_price END, cast(side = result AS int), CASE WHEN side = 'yes' THEN no_price ELSE yes_price END, cast(side <> result AS int)) AS (price, won)")
    s = s.withColumns({"size_bin": F.round(log_bin(F.expr("cnt * price / 100d")), 8), "x": F.expr("won - price / 100d")}).groupBy("size_bin")
    s = s.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cnt * price)").alias("volume_cents"), F.expr("round(avg(won * 1d), 8)").alias("win_rate"), F.expr("round(avg(price / 100d), 8)").alias("expected"), F.expr("round(avg(x), 8)").alias("excess"), F.expr("round(var_samp(x), 8)").alias("var_samp"), F.expr("round(sqrt(var_samp(x) / count(1)), 8)").alias("se"), F.expr("round(1.96d * sqrt(var_samp(x) / count(1)), 8)").alias("ci"))
    return s.where("n >= 10")


def daily_grid(spark, sf_dir):
    """Trades and wins by day and price on a full grid, running totals carried over days without trades."""
    t = adapter.ticks(spark, sf_dir).selectExpr("cast(ts AS date) AS dy", "price", "CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END AS won").groupBy("dy", "price").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    span = t.agg(F.min("dy").alias("a"), F.max("dy").alias("b")).select(F.explode(F.sequence("a", "b")).alias("dy"))
    prices = F.explode(F.sequence(F.lit(1), F.lit(99))).alias("price")
    run = Window.partitionBy("price").orderBy("dy")
    grid = span.select("dy", prices).join(t, ["dy", "price"], "left")
    return grid.select("dy", "price", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("n"), F.coalesce(F.sum("w").over(run), F.lit(0)).alias("w"))


_GRID = """, t AS (SELECT CAST(ts AS DATE) AS dy, price, count(*) AS n, sum(CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS w FROM ticks GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series((SELECT min(dy) FROM t)::TIMESTAMP, (SELECT max(dy) FROM t)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS dy), prices AS (SELECT CAST(range AS INTEGER) AS price FROM range(1, 100)),
grid AS (SELECT d.dy, p.price, CAST(coalesce(sum(t.n) OVER w, 0) AS BIGINT) AS n, CAST(coalesce(sum(t.w) OVER w, 0) AS BIGINT) AS w FROM days d CROSS JOIN prices p LEFT JOIN t ON t.dy = d.dy AND t.price = p.price WINDOW w AS (PARTITION BY p.price ORDER BY d.dy))
"""


@query("cumulative_win_rate", _GRID + "SELECT dy, price, n, w AS wins, 100.0 * w / nullif(n, 0) AS win_rate FROM grid")
def cumulative_win_rate(spark, sf_dir):
    return daily_grid(spark, sf_dir).selectExpr("dy", "price", "n", "w AS wins", "100d * w / nullif(n, 0) AS win_rate")


@query("win_rate_at_last_day", _GRID + "SELECT price, n, w AS wins, 100.0 * w / nullif(n, 0) AS win_rate FROM grid WHERE dy = (SELECT max(dy) FROM grid)")
def win_rate_at_last_day(spark, sf_dir):
    """The frames' final state: the latest snapshot on or before the last day."""
    return daily_grid(spark, sf_dir).groupBy("price").agg(F.max_by(F.struct("n", "w"), "dy").alias("s")).selectExpr("price", "s.n AS n", "s.w AS wins", "100d * s.w / nullif(s.n, 0) AS win_rate")


@query("win_rate_at_day", _GRID + "SELECT price, n, w AS wins, 100.0 * w / nullif(n, 0) AS win_rate FROM grid WHERE dy = DATE '2024-01-15'")
def win_rate_at_day(spark, sf_dir, day: str = "2024-01-15"):
    """The latest snapshot on or before any ``day``; prices without one have no win rate. No row comes from later ticks."""
    t = adapter.ticks(spark, sf_dir).where(F.to_date("ts") <= F.lit(day).cast("date")).groupBy("price").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind").isin("purchase", "signup")).alias("wins"))
    s = spark.range(1, 100).selectExpr("cast(id AS int) AS price").join(t, "price", "left")
    return s.selectExpr("price", "coalesce(n, 0L) AS n", "coalesce(wins, 0L) AS wins", "100d * wins / nullif(n, 0) AS win_rate")


@query("calibration_mad_weekly", """, b AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, price, count(*) AS n, sum(CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS w FROM ticks GROUP BY ALL),
weeks AS (SELECT CAST(unnest(generate_series((SELECT min(week_end) FROM b)::TIMESTAMP, (SELECT max(week_end) FROM b)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_end), prices AS (SELECT DISTINCT price FROM b),
g AS (SELECT k.week_end, p.price, sum(b.n) OVER w AS n, sum(b.w) OVER w AS w FROM weeks k CROSS JOIN prices p LEFT JOIN b ON b.week_end = k.week_end AND b.price = p.price WINDOW w AS (PARTITION BY p.price ORDER BY k.week_end))
SELECT CAST(week_end AS DATE) AS week_end, CAST(sum(n) AS BIGINT) AS n, round(avg(abs(100.0 * w / n - price)), 8) AS mean_absolute_deviation FROM g WHERE n > 0 GROUP BY week_end HAVING sum(n) >= 1000""")
def calibration_mad_weekly(spark, sf_dir, least: int = 1000):
    """Every Sunday from the first trade's week to the last's, with or without trades of its own.

    A trade goes to the Sunday that ends its week; running sums replace a join on 'traded before the week's end'. Each of
    the 99 prices gets the calendar's weeks along with its own, so the ticks are scanned once.
    """
    b = adapter.ticks(spark, sf_dir).selectExpr("date_add(cast(date_trunc('week', ts) AS date), 6) AS week_end", "price", "CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END AS won").groupBy("week_end", "price").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    p = b.groupBy("price").agg(F.collect_list(F.struct("week_end", "n", "w")).alias("weeks"), F.min("week_end").alias("a"), F.max("week_end").alias("z"))
    p = p.withColumns({"a": F.min("a").over(Window.partitionBy()), "z": F.max("z").over(Window.partitionBy())})  # 99 rows
    filled = p.selectExpr("price", "inline(concat(weeks, transform(sequence(a, z, interval 7 days), d -> named_struct('week_end', d, 'n', 0L, 'w', 0L))))").groupBy("price", "week_end").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    run = Window.partitionBy("price").orderBy("week_end")
    g = filled.select("week_end", "price", F.sum("n").over(run).alias("n"), F.sum("w").over(run).alias("w")).where("n > 0")
    return g.groupBy("week_end").agg(F.sum("n").alias("n"), F.expr("round(avg(abs(100d * w / n - price)), 8)").alias("mean_absolute_deviation")).where(F.col("n") >= least)


@query("daily_windows", "SELECT CAST(ts AS DATE) AS dy, kind, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS contracts FROM ticks GROUP BY ALL")
def daily_windows(spark, sf_dir):
    w = adapter.ticks(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("contracts"))
    return w.selectExpr("cast(w.start AS date) AS dy", "kind", "n", "contracts")


@query("recent_window", ", e AS (SELECT max(traded_on) AS b FROM trades) SELECT count(*) AS n, CAST(sum(cnt) AS BIGINT) AS contracts, min(traded_on) AS first_day, max(traded_on) AS last_day FROM trades, e WHERE traded_on >= b - INTERVAL 1 YEAR AND traded_on <= b")
def recent_window(spark, sf_dir):
    t = adapter.trades(spark, sf_dir)
    end = t.agg(F.max("traded_on")).first()[0]
    held = t.where(F.col("traded_on").between(F.add_months(F.lit(end), -12), F.lit(end)))
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("contracts"), F.min("traded_on").alias("first_day"), F.max("traded_on").alias("last_day"))
