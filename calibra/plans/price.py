"""Results by price, role and direction."""

from pyspark.sql import functions as F

from calibra.operators.positions import cells, dual, joined, positions
from calibra.plans.base import query
from calibra.sources import adapter

WINS = "cast(sum(n * won) AS bigint)"


@query("win_rate_by_price", "SELECT price, count(*) AS total_trades, CAST(sum(won) AS BIGINT) AS wins, 100.0 * sum(won) / count(*) AS win_rate FROM positions GROUP BY price")
def win_rate_by_price(spark, sf_dir):
    p = positions(spark, sf_dir).groupBy("price").agg(F.sum("n").alias("total_trades"), F.expr(WINS).alias("wins"))
    return p.withColumn("win_rate", F.lit(100.0) * F.col("wins") / F.col("total_trades"))


@query("mispricing_by_price", """, m AS (SELECT price, count(*) FILTER (role = 'taker') AS taker_trades, CAST(sum(won) FILTER (role = 'taker') AS BIGINT) AS taker_wins,
  count(*) FILTER (role = 'maker') AS maker_trades, CAST(sum(won) FILTER (role = 'maker') AS BIGINT) AS maker_wins, count(*) AS combined_trades, CAST(sum(won) AS BIGINT) AS combined_wins
  FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price)
SELECT *, round(100.0 * taker_wins / taker_trades - price, 8) AS taker_pp, round(100.0 * maker_wins / maker_trades - price, 8) AS maker_pp, round(100.0 * combined_wins / combined_trades - price, 8) AS combined_pp,
  round((100.0 * combined_wins / combined_trades - price) / price * 100.0, 8) AS combined_pct FROM m WHERE taker_trades > 0 AND maker_trades > 0""")
def mispricing_by_price(spark, sf_dir):
    of = lambda role: F.when(F.col("role") == role, F.col("n"))
    p = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price")
    p = p.agg(*[x for r in ("taker", "maker") for x in (F.sum(of(r)).alias(f"{r}_trades"), F.sum(of(r) * F.col("won")).alias(f"{r}_wins"))], F.sum("n").alias("combined_trades"), F.sum(F.col("n") * F.col("won")).alias("combined_wins"))
    p = p.where("taker_trades > 0 AND maker_trades > 0")
    pp = lambda r: F.lit(100.0) * F.col(f"{r}_wins") / F.col(f"{r}_trades") - F.col("price")
    return p.withColumns({f"{r}_pp": F.round(pp(r), 8) for r in ("taker", "maker", "combined")} | {"combined_pct": F.round(pp("combined") / F.col("price") * F.lit(100.0), 8)})


_ROLES = """, r AS (SELECT price, role, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(cnt) AS BIGINT) AS contracts, CAST(sum(cnt * price) AS BIGINT) AS volume_cents,
  CAST(sum(cnt * (100 * won - price)) AS BIGINT) AS pnl_cents FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price, role),
s AS (SELECT *, wins * 1.0 / n AS win_rate, wins * 1.0 / n - price / 100.0 AS excess, (wins * 1.0 / n) * (1.0 - wins * 1.0 / n) AS var FROM r)
SELECT price, role, n, wins, contracts, volume_cents, pnl_cents, round(win_rate, 8) AS win_rate, round(excess, 8) AS excess, round(var, 8) AS var_pop, round(sqrt(var / n), 8) AS se,
  round(excess / nullif(sqrt(var / n), 0), 6) AS z FROM s"""


def by_role(spark, sf_dir):
    p = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price", "role")
    r = p.agg(F.sum("n").alias("n"), F.expr(WINS).alias("wins"), F.sum("contracts").alias("contracts"), F.expr("sum(contracts * price)").alias("volume_cents"), F.expr("sum(contracts * (100 * won - price))").alias("pnl_cents"))
    s = r.selectExpr("*", "wins * 1d / n AS win_rate", "wins * 1d / n - price / 100d AS excess", "(wins * 1d / n) * (1d - wins * 1d / n) AS var")
    return s.selectExpr("price", "role", "n", "wins", "contracts", "volume_cents", "pnl_cents", "round(win_rate, 8) AS win_rate", "round(excess, 8) AS excess", "round(var, 8) AS var_pop", "round(sqrt(var / n), 8) AS se", "round(excess / nullif(sqrt(var / n), 0d), 6) AS z")


query("maker_vs_taker_returns", _ROLES)(by_role)


def _direction(role_filter: str, weighted: bool) -> str:
    num, den = ("won * cnt", "cnt") if weighted else ("won", "1")
    return f""", d AS (SELECT price, direction, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS contracts, round(sum({num}) * 1.0 / sum({den}) - price / 100.0, 8) AS excess FROM positions WHERE {role_filter} GROUP BY price, direction),
y AS (SELECT * FROM d WHERE direction = 'yes'), o AS (SELECT * FROM d WHERE direction = 'no')
SELECT coalesce(y.price, o.price) AS price, y.n AS yes_n, y.contracts AS yes_contracts, y.excess AS yes_excess, o.n AS no_n, o.contracts AS no_contracts, o.excess AS no_excess, round(y.excess - o.excess, 6) AS diff
FROM y FULL OUTER JOIN o ON y.price = o.price"""


def by_direction(spark, sf_dir, weighted):
    w = "contracts" if weighted else "n"
    d = positions(spark, sf_dir).where("role = 'maker'").groupBy("price", "direction").agg(F.sum("n").alias("n"), F.sum("contracts").alias("contracts"), F.expr(f"sum({w} * won) * 1d / sum({w})").alias("rate"))
    d = d.withColumn("excess", F.round(F.col("rate") - F.col("price") / F.lit(100.0), 8))
    side = lambda s: d.where(F.col("direction") == s).select("price", *[F.col(c).alias(f"{s}_{c}") for c in ("n", "contracts", "excess")])
    return side("yes").join(side("no"), "price", "full").withColumn("diff", F.round(F.col("yes_excess") - F.col("no_excess"), 6))


query("maker_returns_by_direction", _direction("role = 'maker'", False))(lambda spark, sf_dir: by_direction(spark, sf_dir, False))
query("maker_win_rate_by_direction", _direction("role = 'maker'", True))(lambda spark, sf_dir: by_direction(spark, sf_dir, True))


@query("ev_yes_vs_no", """, e AS (SELECT price, direction, sum(cnt * won) * 100.0 / sum(cnt) - price AS ev, CAST(sum(cnt) AS BIGINT) AS contracts FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price, direction),
spine AS (SELECT CAST(range AS INTEGER) AS price FROM range(1, 100))
SELECT s.price, round(y.ev, 8) AS yes_ev, round(o.ev, 8) AS no_ev, coalesce(y.contracts, 0) AS yes_contracts, coalesce(o.contracts, 0) AS no_contracts,
  round(greatest(coalesce(y.ev, -100.0), coalesce(o.ev, -100.0)), 8) AS best_ev, CASE WHEN coalesce(y.ev, -100.0) > coalesce(o.ev, -100.0) THEN 'YES' ELSE 'NO' END AS best_bet
FROM spine s LEFT JOIN e y ON y.price = s.price AND y.direction = 'yes' LEFT JOIN e o ON o.price = s.price AND o.direction = 'no'""")
def ev_yes_vs_no(spark, sf_dir):
    of = lambda d, x: F.sum(F.when(F.col("direction") == d, F.expr(x)))
    e = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price").agg(*[x for d in ("yes", "no") for x in (of(d, "contracts * won").alias(f"{d}_won"), of(d, "contracts").alias(f"{d}_contracts"))])
    spine = spark.range(1, 100).selectExpr("cast(id AS int) AS price")
    e = spine.join(e, "price", "left").selectExpr("*", "yes_won * 100d / yes_contracts - price AS y", "no_won * 100d / no_contracts - price AS o")
    return e.selectExpr("price", "round(y, 8) AS yes_ev", "round(o, 8) AS no_ev", "coalesce(yes_contracts, 0L) AS yes_contracts", "coalesce(no_contracts, 0L) AS no_contracts", "round(greatest(coalesce(y, -100d), coalesce(o, -100d)), 8) AS best_ev", "CASE WHEN coalesce(y, -100d) > coalesce(o, -100d) THEN 'YES' ELSE 'NO' END AS best_bet")


@query("yes_vs_no_by_price", """, keys AS (SELECT DISTINCT yes_price AS price FROM trades UNION SELECT DISTINCT no_price FROM trades),
c AS (SELECT k.price, coalesce((SELECT sum(cnt) FROM trades t WHERE side = 'yes' AND yes_price = k.price), 0) AS taker_yes, coalesce((SELECT sum(cnt) FROM trades t WHERE side = 'no' AND no_price = k.price), 0) AS taker_no,
 coalesce((SELECT sum(cnt) FROM trades t WHERE side = 'no' AND yes_price = k.price), 0) AS maker_yes, coalesce((SELECT sum(cnt) FROM trades t WHERE side = 'yes' AND no_price = k.price), 0) AS maker_no FROM keys k)
SELECT price, CAST(taker_yes AS BIGINT) AS taker_yes, CAST(taker_no AS BIGINT) AS taker_no, CAST(maker_yes AS BIGINT) AS maker_yes, CAST(maker_no AS BIGINT) AS maker_no, CAST(taker_yes + taker_no + maker_yes + maker_no AS BIGINT) AS total,
 100.0 * taker_yes / (taker_yes + taker_no + maker_yes + maker_no) AS taker_yes_pct, 100.0 * taker_no / (taker_yes + taker_no + maker_yes + maker_no) AS taker_no_pct,
 100.0 * maker_yes / (taker_yes + taker_no + maker_yes + maker_no) AS maker_yes_pct, 100.0 * maker_no / (taker_yes + taker_no + maker_yes + maker_no) AS maker_no_pct FROM c WHERE price BETWEEN 1 AND 99""")
def yes_vs_no_by_price(spark, sf_dir):
    all_cells = adapter.trades(spark, sf_dir).groupBy("yes_price", "side").agg(F.sum("cnt").alias("contracts"), F.count(F.lit(1)).alias("n")).withColumn("result", F.lit(""))
    p = dual(all_cells).where(F.col("price").between(1, 99)).groupBy("price")
    of = lambda r, d: F.coalesce(F.sum(F.when((F.col("role") == r) & (F.col("direction") == d), F.col("contracts"))), F.lit(0)).cast("long").alias(f"{r}_{d}")
    p = p.agg(of("taker", "yes"), of("taker", "no"), of("maker", "yes"), of("maker", "no"), F.sum("contracts").alias("total"))
    return p.withColumns({f"{c}_pct": F.lit(100.0) * F.col(c) / F.col("total") for c in ("taker_yes", "taker_no", "maker_yes", "maker_no")})


@query("calibration_by_bucket", """, b AS (SELECT CAST(floor(price / 10.0) * 10 AS INTEGER) AS bucket_low, count(*) AS total, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(price) AS BIGINT) AS price_sum FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY 1)
SELECT bucket_low, total, wins, price_sum / (100.0 * total) AS mean_predicted, wins * 1.0 / total AS actual_rate FROM b""")
def calibration_by_bucket(spark, sf_dir):
    b = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy(F.expr("cast(floor(price / 10d) * 10 AS int)").alias("bucket_low"))
    return b.agg(F.sum("n").alias("total"), F.expr(WINS).alias("wins"), F.expr("sum(n * price)").alias("p")).selectExpr("bucket_low", "total", "wins", "p / (100d * total) AS mean_predicted", "wins * 1d / total AS actual_rate")


@query("calibration_metrics", """, c AS (SELECT price, count(*) AS n, sum(won) AS wins FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price),
g AS (SELECT *, abs(wins * 1.0 / n - price / 100.0) AS gap, wins * pow(price / 100.0 - 1.0, 2) + (n - wins) * pow(price / 100.0, 2) AS sq, -(wins * ln(greatest(price / 100.0, 1e-6)) + (n - wins) * ln(greatest(1.0 - price / 100.0, 1e-6))) AS ll FROM c)
SELECT round(sum(sq) / sum(n), 8) AS brier, round(sum(ll) / sum(n), 8) AS log_loss, round(sum(n * gap) / sum(n), 8) AS ece, round(max(gap), 8) AS mce FROM g""")
def calibration_metrics(spark, sf_dir):
    c = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price").agg(F.sum("n").alias("n"), F.expr(WINS).alias("wins"))
    g = c.selectExpr("*", "price / 100d AS q").selectExpr("n", "abs(wins * 1d / n - q) AS gap", "wins * pow(q - 1d, 2d) + (n - wins) * pow(q, 2d) AS sq", "-(wins * ln(greatest(q, 1e-6d)) + (n - wins) * ln(greatest(1d - q, 1e-6d))) AS ll")
    return g.selectExpr("round(sum(sq) / sum(n), 8) AS brier", "round(sum(ll) / sum(n), 8) AS log_loss", "round(sum(n * gap) / sum(n), 8) AS ece", "round(max(gap), 8) AS mce")


@query("roi_by_price", """SELECT direction, price, count(*) AS n, round(sum(100.0 * won - price) / sum(price), 8) AS roi, round(sum(cnt * (100.0 * won - price)) / sum(cnt * price), 8) AS unit_roi FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY direction, price""")
def roi_by_price(spark, sf_dir):
    p = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("direction", "price")
    return p.agg(F.sum("n").alias("n"), F.expr("round(sum(n * (100 * won - price)) * 1d / sum(n * price), 8)").alias("roi"), F.expr("round(sum(contracts * (100 * won - price)) * 1d / sum(contracts * price), 8)").alias("unit_roi"))


@query("capital_share", """, c AS (SELECT price, role, direction, sum(cnt * price) AS cents FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY ALL),
p AS (SELECT price, coalesce(sum(cents) FILTER (role = 'taker' AND direction = 'yes'), 0) AS ty, coalesce(sum(cents) FILTER (role = 'taker' AND direction = 'no'), 0) AS tn, coalesce(sum(cents) FILTER (role = 'maker' AND direction = 'yes'), 0) AS my, coalesce(sum(cents) FILTER (role = 'maker' AND direction = 'no'), 0) AS mn FROM c GROUP BY price)
SELECT price, 100.0 * ty / (ty + tn + my + mn) AS taker_yes, 100.0 * tn / (ty + tn + my + mn) AS taker_no, 100.0 * my / (ty + tn + my + mn) AS maker_yes, 100.0 * mn / (ty + tn + my + mn) AS maker_no FROM p""")
def capital_share(spark, sf_dir):
    p = positions(spark, sf_dir).where(F.col("price").between(1, 99)).withColumn("cell", F.concat_ws("_", "role", "direction"))
    names = ["taker_yes", "taker_no", "maker_yes", "maker_no"]
    wide = p.groupBy("price").pivot("cell", names).agg(F.expr("sum(contracts * price)")).na.fill(0)
    return wide.select("price", *[(F.lit(100.0) * F.col(c) / sum(F.col(x) for x in names)).alias(c) for c in names])


@query("capital_bands", """SELECT CAST(floor((price - 1) / 10.0) AS INTEGER) AS band, direction, CAST(sum(cnt * price) AS BIGINT) AS cents, 100.0 * sum(cnt * price) / sum(sum(cnt * price)) OVER (PARTITION BY direction) AS share
FROM positions WHERE role = 'taker' GROUP BY 1, direction""")
def capital_bands(spark, sf_dir):
    from pyspark.sql.window import Window

    c = positions(spark, sf_dir).where("role = 'taker'").groupBy(F.expr("cast(floor((price - 1) / 10d) AS int)").alias("band"), "direction").agg(F.expr("sum(contracts * price)").alias("cents"))
    return c.withColumn("share", F.lit(100.0) * F.col("cents") / F.sum("cents").over(Window.partitionBy("direction")))


@query("price_extremes", """, w AS (SELECT price, sum(won) * 1.0 / count(*) - price / 100.0 AS gap FROM positions GROUP BY price HAVING count(*) >= 10)
SELECT arg_max(price, (gap, price)) AS best_price, round(max(gap), 8) AS best_gap, arg_min(price, (gap, price)) AS worst_price, round(min(gap), 8) AS worst_gap FROM w""")
def price_extremes(spark, sf_dir):
    w = positions(spark, sf_dir).groupBy("price").agg(F.sum("n").alias("n"), F.expr(WINS).alias("wins")).where("n >= 10").selectExpr("price", "wins * 1d / n - price / 100d AS gap")
    return w.selectExpr("max_by(price, struct(gap, price)) AS best_price", "round(max(gap), 8) AS best_gap", "min_by(price, struct(gap, price)) AS worst_price", "round(min(gap), 8) AS worst_gap")


@query("complement_gap", """, w AS (SELECT price, role, sum(won) * 1.0 / count(*) AS rate FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price, role)
SELECT t.price, round(t.rate, 8) AS taker_rate, round(m.rate, 8) AS maker_rate_at_complement, round(t.rate + m.rate, 8) AS total FROM w t LEFT JOIN w m ON m.role = 'maker' AND m.price = 100 - t.price WHERE t.role = 'taker'""")
def complement_gap(spark, sf_dir):
    w = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price", "role").agg((F.expr("sum(n * won)") * F.lit(1.0) / F.sum("n")).alias("rate"))
    m = w.where("role = 'maker'").selectExpr("100 - price AS price", "rate AS other")
    return w.where("role = 'taker'").join(m, "price", "left").selectExpr("price", "round(rate, 8) AS taker_rate", "round(other, 8) AS maker_rate_at_complement", "round(rate + other, 8) AS total")


@query("conservation_checks", """SELECT (SELECT count(*) FROM positions) AS positions, (SELECT 2 * count(*) FROM joined) AS twice_trades, (SELECT CAST(sum(cnt * (100 * won - price)) AS BIGINT) FROM positions) AS pnl_cents, (SELECT CAST(sum(won) AS BIGINT) FROM positions) AS wins""")
def conservation_checks(spark, sf_dir):
    """Trades are counted from the cells before they become positions; the few cells are carried along, so that one pass serves both."""
    one = cells(joined(spark, sf_dir)).agg(F.sum("n").alias("trades"), F.collect_list(F.struct("*")).alias("cells"))  # 396 cells at most
    p = dual(one.select("trades", F.inline("cells")), "trades")
    return p.selectExpr("sum(n) AS positions", "2 * max(trades) AS twice_trades", "sum(contracts * (100 * won - price)) AS pnl_cents", "sum(n * won) AS wins")


@query("decomposition", """, p AS (SELECT price, role, direction, sum(cnt) AS w, sum(cnt * won) * 1.0 / sum(cnt) - price / 100.0 AS m FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price, role, direction),
all_p AS (SELECT price, sum(cnt) AS w, sum(cnt * won) * 1.0 / sum(cnt) - price / 100.0 AS m FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price),
all_d AS (SELECT price, direction, sum(cnt) AS w, sum(cnt * won) * 1.0 / sum(cnt) - price / 100.0 AS m FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price, direction),
t AS (SELECT p.w, p.m, a.m AS am, d.m AS dm FROM p JOIN all_p a USING (price) JOIN all_d d USING (price, direction) WHERE p.role = 'taker')
SELECT round(sum(w * am) / sum(w), 8) AS by_price, round(sum(w * (dm - am)) / sum(w), 8) AS by_direction, round(sum(w * (m - dm)) / sum(w), 8) AS by_execution, round(sum(w * m) / sum(w), 8) AS total FROM t""")
def decomposition(spark, sf_dir):
    """A taker's mispricing as what any position at the price has, what its direction adds, and what taking adds."""
    from pyspark.sql.window import Window

    p = positions(spark, sf_dir).where(F.col("price").between(1, 99)).groupBy("price", "role", "direction").agg(F.sum("contracts").alias("w"), F.expr("sum(contracts * won)").alias("won"))
    rate = lambda *keys: F.sum("won").over(Window.partitionBy(*keys)) * F.lit(1.0) / F.sum("w").over(Window.partitionBy(*keys)) - F.col("price") / F.lit(100.0)
    t = p.withColumns({"am": rate("price"), "dm": rate("price", "direction"), "m": F.expr("won * 1d / w - price / 100d")}).where("role = 'taker'")
    return t.selectExpr("round(sum(w * am) / sum(w), 8) AS by_price", "round(sum(w * (dm - am)) / sum(w), 8) AS by_direction", "round(sum(w * (m - dm)) / sum(w), 8) AS by_execution", "round(sum(w * m) / sum(w), 8) AS total")
