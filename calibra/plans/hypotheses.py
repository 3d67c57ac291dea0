"""Hypothesis tests with their p-values: asymmetry of YES and NO, role, group, size and direction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.functions.buckets import equal_width
from calibra.functions.stats import normal_sql, normal_two_sided, normal_upper, student_sql, student_two_sided
from calibra.operators.positions import joined, positions
from calibra.plans.base import ORACLE_SQL, QUERIES, onward, query
from calibra.plans.inference import mann_whitney, welch
from calibra.plans.price import by_role

#: Decimals that a p-value is given with; the SQL's series has some nine.
P = 7


@query("maker_vs_taker_p_values", onward("maker_vs_taker_returns", f"SELECT price, role, z, round({normal_sql('z')}, {P}) AS p_value FROM rows_"))
def maker_vs_taker_p_values(spark, sf_dir):
    """The two-sided normal p of each role's excess return."""
    return by_role(spark, sf_dir).select("price", "role", "z", F.round(normal_two_sided("z"), P).alias("p_value"))


@query("mann_whitney_p_values", onward("mann_whitney", f"SELECT band, z, round({normal_sql('z', upper=True)}, {P}) AS p_value FROM rows_"))
def mann_whitney_p_values(spark, sf_dir):
    return mann_whitney(spark, sf_dir).select("band", "z", F.round(normal_upper("z"), P).alias("p_value"))


@query("welch_p_values", onward("welch", f"SELECT segment, t, dof, round({student_sql('t', 'dof')}, 6) AS p_value FROM rows_"))
def welch_p_values(spark, sf_dir):
    return welch(spark, sf_dir).select("segment", "t", "dof", F.round(student_two_sided("t", "dof"), 6).alias("p_value"))


_TESTED = (1, 2, 3, 4, 5, 10, 15, 20, 25, 50, 75, 80, 85, 90, 95, 96, 97, 98, 99)
_IN = ", ".join(map(str, _TESTED))


@query("yes_no_asymmetry", f""", g AS (SELECT price, direction, count(*) AS n, sum(cnt) AS c, sum(cnt * won) AS w FROM positions WHERE role = 'taker' AND price IN ({_IN}) GROUP BY ALL),
j AS (SELECT y.price, y.c * 1.0 AS n1, y.w * 1.0 AS w1, o.c * 1.0 AS n2, o.w * 1.0 AS w2 FROM g y JOIN g o ON y.price = o.price AND y.direction = 'yes' AND o.direction = 'no' WHERE y.n >= 100 AND o.n >= 100),
k AS (SELECT *, (w1 + w2) / (n1 + n2) AS q FROM j), s AS (SELECT *, sqrt(q * (1.0 - q) * (1.0 / n1 + 1.0 / n2)) AS se FROM k),
z AS (SELECT *, round(CASE WHEN se > 0 THEN (w2 / n2 - w1 / n1) / se ELSE 0 END, 6) AS z_statistic FROM s)
SELECT price, round(w1 / n1, 8) AS yes_win_rate, round(w2 / n2, 8) AS no_win_rate, round(100.0 * (w2 / n2 - w1 / n1), 6) AS diff_pp, round((100.0 * w1 / n1 - price) / price * 100, 6) AS yes_ev, round((100.0 * w2 / n2 - price) / price * 100, 6) AS no_ev,
  z_statistic, round({normal_sql('z_statistic')}, {P}) AS p_value, CAST(n1 AS BIGINT) AS yes_n, CAST(n2 AS BIGINT) AS no_n, w2 / n2 > w1 / n1 AS no_better FROM z""")
def yes_no_asymmetry(spark, sf_dir):
    """Takers of YES against takers of NO at one price, weighted by contracts: rates, returns, the pooled z and its p."""
    of = lambda d, x: F.sum(F.when(F.col("direction") == d, F.expr(x)))
    g = positions(spark, sf_dir).where(f"role = 'taker' AND price IN ({_IN})").groupBy("price")
    g = g.agg(of("yes", "n").alias("a"), of("no", "n").alias("b"), of("yes", "cast(contracts AS double)").alias("n1"), of("yes", "cast(contracts * won AS double)").alias("w1"), of("no", "cast(contracts AS double)").alias("n2"), of("no", "cast(contracts * won AS double)").alias("w2"))
    s = g.where("a >= 100 AND b >= 100").selectExpr("*", "(w1 + w2) / (n1 + n2) AS q").selectExpr("*", "sqrt(q * (1d - q) * (1d / n1 + 1d / n2)) AS se")
    z = s.selectExpr("*", "round(CASE WHEN se > 0 THEN (w2 / n2 - w1 / n1) / se ELSE 0d END, 6) AS z_statistic")
    return z.select("price", *[F.expr(x) for x in ("round(w1 / n1, 8) AS yes_win_rate", "round(w2 / n2, 8) AS no_win_rate", "round(100d * (w2 / n2 - w1 / n1), 6) AS diff_pp", "round((100d * w1 / n1 - price) / price * 100, 6) AS yes_ev", "round((100d * w2 / n2 - price) / price * 100, 6) AS no_ev")],
                    "z_statistic", F.round(normal_two_sided("z_statistic"), P).alias("p_value"), F.col("n1").cast("long").alias("yes_n"), F.col("n2").cast("long").alias("no_n"), F.expr("w2 / n2 > w1 / n1 AS no_better"))


_RANGES = ((1, 10), (11, 25), (26, 50), (51, 75), (76, 90), (91, 99))
_RANGE = "CASE " + " ".join(f"WHEN price BETWEEN {a} AND {z} THEN {a}" for a, z in _RANGES) + " END"


@query("maker_direction_by_range", f""", v AS (SELECT {_RANGE} AS from_price, direction, cnt, least(cnt, 100) AS w, won - price / 100.0 AS x FROM positions WHERE role = 'maker' AND price BETWEEN 1 AND 99),
g AS (SELECT from_price, direction, count(*) AS trades, sum(w) * 1.0 AS n, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS q, sum(cnt * x) / sum(cnt) AS e FROM v GROUP BY ALL),
s AS (SELECT *, (q - m * m) * n / (n - 1) AS s FROM g WHERE trades >= 100),
b AS (SELECT y.from_price, y.n AS n1, o.n AS n2, y.m AS m1, o.m AS m2, y.e AS x1, o.e AS x2, y.s / y.n AS e1, o.s / o.n AS e2, sqrt(((y.n - 1) * y.s + (o.n - 1) * o.s) / (y.n + o.n - 2)) AS pooled FROM s y JOIN s o ON y.from_price = o.from_price AND y.direction = 'yes' AND o.direction = 'no'),
t AS (SELECT *, round((m2 - m1) / sqrt(e1 + e2), 5) AS t, round(pow(e1 + e2, 2) / (pow(e1, 2) / (n1 - 1) + pow(e2, 2) / (n2 - 1)), 3) AS dof FROM b)
SELECT from_price, round(x1, 7) AS yes_excess, round(x2, 7) AS no_excess, t, dof, round({student_sql('t', 'dof')}, 5) AS p_value, round((m2 - m1) / pooled, 6) AS cohens_d, CAST(n1 AS BIGINT) AS yes_n, CAST(n2 AS BIGINT) AS no_n, x2 > x1 AS no_better FROM t""")
def maker_direction_by_range(spark, sf_dir):
    """Makers of NO against makers of YES by price range: excess a contract, Welch's t, its p and Cohen's d.

    Moments weighted by contracts, 100 a trade at most, are those of returns repeated as often, without repeating or drawing them.
    """
    p = joined(spark, sf_dir).selectExpr("CASE WHEN side = 'yes' THEN no_price ELSE yes_price END AS price", "CASE WHEN side = 'yes' THEN 'no' ELSE 'yes' END AS direction", "cnt", "cast(side <> result AS int) AS won").where("price BETWEEN 1 AND 99")
    p = p.selectExpr(f"{_RANGE} AS from_price", "direction", "cnt", "cast(least(cnt, 100) AS double) AS w", "won - price / 100d AS x")
    g = p.groupBy("from_price", "direction").agg(F.count(F.lit(1)).alias("trades"), F.sum("w").alias("n"), F.expr("sum(w * x) / sum(w)").alias("m"), F.expr("sum(w * x * x) / sum(w)").alias("q"), F.expr("sum(cnt * x) / sum(cnt)").alias("e")).where("trades >= 100")
    s = g.selectExpr("from_price", "direction", "n", "m", "e", "(q - m * m) * n / (n - 1) AS s")
    of = lambda d, c, k: F.max(F.when(F.col("direction") == d, F.col(c))).alias(k)
    wide = s.groupBy("from_price").agg(*[of(d, c, f"{c}{k}") for k, d in ((1, "yes"), (2, "no")) for c in ("n", "m", "e", "s")]).dropna()
    b = wide.selectExpr("*", "s1 / n1 AS v1", "s2 / n2 AS v2", "sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS pooled")
    t = b.selectExpr("*", "round((m2 - m1) / sqrt(v1 + v2), 5) AS t", "round(pow(v1 + v2, 2d) / (pow(v1, 2d) / (n1 - 1) + pow(v2, 2d) / (n2 - 1)), 3) AS dof")
    return t.select("from_price", F.round("e1", 7).alias("yes_excess"), F.round("e2", 7).alias("no_excess"), "t", "dof", F.round(student_two_sided("t", "dof"), 5).alias("p_value"), F.expr("round((m2 - m1) / pooled, 6) AS cohens_d"), F.col("n1").cast("long").alias("yes_n"), F.col("n2").cast("long").alias("no_n"), F.expr("e2 > e1 AS no_better"))


_SIZES = """, v AS (SELECT cnt * price AS cents, 100 * won - price AS x FROM positions WHERE role = 'taker'), c AS (SELECT cents, x, count(*) AS n, log10(greatest(cents / 100.0, 0.01)) AS l FROM v GROUP BY cents, x),
rc AS (SELECT cents, sum(sum(n)) OVER (ORDER BY cents) - sum(n) + (sum(n) + 1) / 2.0 AS r FROM c GROUP BY cents), rx AS (SELECT x, sum(sum(n)) OVER (ORDER BY x) - sum(n) + (sum(n) + 1) / 2.0 AS r FROM c GROUP BY x)
"""


def size_cells(spark, sf_dir):
    """(cents, x, n, l): takers' trades by size in cents and return, with the logarithm of the size in dollars."""
    t = joined(spark, sf_dir).selectExpr("cnt * (CASE WHEN side = 'yes' THEN yes_price ELSE no_price END) AS cents", "100 * cast(side = result AS int) - (CASE WHEN side = 'yes' THEN yes_price ELSE no_price END) AS x")
    return t.groupBy("cents", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("l", F.log10(F.greatest(F.col("cents") / F.lit(100.0), F.lit(0.01))))


def moment(a: str, b: str) -> str:
    """The correlation of a and b, weighted by n, from means and centred sums' parts."""
    cov = f"(sum(n * {a} * {b}) / sum(n) - sum(n * {a}) / sum(n) * (sum(n * {b}) / sum(n)))"
    var = lambda v: f"(sum(n * {v} * {v}) / sum(n) - sum(n * {v}) / sum(n) * (sum(n * {v}) / sum(n)))"
    return f"{cov} / sqrt({var(a)} * {var(b)})"


_T = "r * sqrt((n - 2) / (1 - r * r))"


@query("size_correlations", _SIZES + f""", j AS (SELECT c.n * 1.0 AS n, c.l AS l, c.x * 1.0 AS x, rc.r / 1000.0 AS a, rx.r / 1000.0 AS b FROM c JOIN rc USING (cents) JOIN rx USING (x)),
m AS (SELECT 'pearson' AS kind, round({moment('l', 'x')}, 8) AS r, CAST(sum(n) AS BIGINT) AS n FROM j UNION ALL SELECT 'spearman', round({moment('a', 'b')}, 8), CAST(sum(n) AS BIGINT) FROM j),
t AS (SELECT *, {_T} AS t FROM m) SELECT kind, r, n, round({student_sql('t', '(n - 2)')}, 5) AS p_value FROM t""")
def size_correlations(spark, sf_dir):
    """Pearson and Spearman of a taker's trade size (its logarithm) and return, over all trades, with p-values. Ranks, averaged over ties, come from the frequencies."""
    c = size_cells(spark, sf_dir)
    rank = lambda k, r: c.groupBy(k).agg(F.sum("n").alias("m")).select(k, ((F.sum("m").over(Window.orderBy(k)) - F.col("m") + (F.col("m") + 1) / F.lit(2.0)) / F.lit(1000.0)).alias(r))  # noqa: E731  distinct sizes and returns
    j = c.join(rank("cents", "a"), "cents", "left").join(rank("x", "b"), "x", "left").selectExpr("cast(n AS double) AS n", "l", "cast(x AS double) AS x", "a", "b")
    m = j.agg(F.expr(f"round({moment('l', 'x')}, 8)").alias("p"), F.expr(f"round({moment('a', 'b')}, 8)").alias("s"), F.expr("cast(sum(n) AS bigint)").alias("n"))
    t = m.selectExpr("stack(2, 'pearson', p, 'spearman', s) AS (kind, r)", "n").withColumn("t", F.expr(_T))
    return t.select("kind", "r", "n", F.round(student_two_sided(F.col("t"), (F.col("n") - 2).cast("double")), 5).alias("p_value"))


@query("size_fit", _SIZES + """, e AS (SELECT min(l) AS a, max(l) AS z FROM c), g AS (SELECT CAST(greatest(1, ceil((l - a) / ((z - a) / 20.0))) AS INTEGER) AS bin, sum(n) * 1.0 AS n, sum(n * l) / sum(n) AS l, sum(n * x / 100.0) / sum(n) AS y FROM c, e GROUP BY 1),
s AS (SELECT sum(n) AS w, sum(n * l) / sum(n) AS ml, sum(n * y) / sum(n) AS my, sum(n * l * y) / sum(n) AS mly, sum(n * l * l) / sum(n) AS mll, sum(sqrt(n) * y) / sum(sqrt(n)) AS wy FROM g),
f AS (SELECT (mly - ml * my) / (mll - ml * ml) AS slope, my - (mly - ml * my) / (mll - ml * ml) * ml AS intercept, wy FROM s)
SELECT round(100 * any_value(slope), 6) AS slope_pp_per_log10, round(any_value(intercept), 7) AS intercept, round(1 - sum(sqrt(n) * pow(y - slope * l - intercept, 2)) / sum(sqrt(n) * pow(y - wy, 2)), 6) AS r_squared, count(*) AS bins FROM g, f""")
def size_fit(spark, sf_dir):
    """Mean return by log size in 20 bins of equal width, and the line through them: squared errors weighted by trades, the fit's share told with their roots."""
    c = size_cells(spark, sf_dir).withColumns({"a": F.min("l").over(Window.partitionBy()), "z": F.max("l").over(Window.partitionBy())})  # distinct sizes and returns
    g = c.groupBy(equal_width(F.col("l"), F.col("a"), F.col("z"), 20).alias("bin")).agg(F.expr("cast(sum(n) AS double)").alias("n"), F.expr("sum(n * l) / sum(n)").alias("l"), F.expr("sum(n * x / 100d) / sum(n)").alias("y"))
    s = g.agg(*[F.expr(f"sum(n * {e}) / sum(n)").alias(k) for k, e in (("ml", "l"), ("my", "y"), ("mly", "l * y"), ("mll", "l * l"))], F.expr("sum(sqrt(n) * y) / sum(sqrt(n))").alias("wy"), F.collect_list(F.struct("n", "l", "y")).alias("bins"))  # 20 of them
    f = s.selectExpr("(mly - ml * my) / (mll - ml * ml) AS slope", "ml", "my", "wy", "bins").selectExpr("slope", "my - slope * ml AS intercept", "wy", "inline(bins)")
    r2 = "1 - sum(sqrt(n) * pow(y - slope * l - intercept, 2d)) / sum(sqrt(n) * pow(y - wy, 2d))"
    return f.agg(F.expr("round(100 * max(slope), 6)").alias("slope_pp_per_log10"), F.expr("round(max(intercept), 7)").alias("intercept"), F.expr(f"round({r2}, 6)").alias("r_squared"), F.count(F.lit(1)).alias("bins"))


_LEVELS = f""", p AS (SELECT ticker, event_id, CASE WHEN side = 'yes' THEN yes_price ELSE no_price END / 100.0 AS p, CAST(side = result AS INTEGER) AS won FROM joined),
m AS (SELECT ticker, any_value(event_id) AS event_id, count(*) * 1.0 AS n, sum(won - p) AS res, sum((won - p) / p) AS roi_t, sum((p - won) / (1 - p)) AS roi_m FROM p GROUP BY ticker),
u AS (SELECT 'market' AS cluster_level, n, res, roi_t, roi_m FROM m UNION ALL SELECT 'event', sum(n), sum(res), sum(roi_t), sum(roi_m) FROM m GROUP BY event_id),
t AS (SELECT cluster_level, count(*) AS g, sum(n) AS n, sum(res) / sum(n) AS res, sum(roi_t) / sum(n) AS roi_t, sum(roi_m) / sum(n) AS roi_m FROM u GROUP BY cluster_level),
i AS (SELECT u.cluster_level, t.g, t.res, t.roi_t, t.roi_m, (u.res - u.n * t.res) / t.n AS ir, (u.roi_t - u.n * t.roi_t) / t.n AS it, (u.roi_m - u.n * t.roi_m) / t.n AS im FROM u JOIN t USING (cluster_level)),
e AS (SELECT cluster_level, g, res, roi_t, roi_m, sum(ir * ir) AS rr, sum(it * it) AS tt, sum(im * im) AS mm, sum((im - it) * (im - it)) AS dd FROM i GROUP BY ALL),
r AS (
  SELECT cluster_level, g, 'mispricing_pp' AS metric, 'taker' AS comparison, res AS v, rr AS ss FROM e UNION ALL SELECT cluster_level, g, 'mispricing_pp', 'maker', -res, rr FROM e UNION ALL SELECT cluster_level, g, 'mispricing_pp', 'maker - taker', -2 * res, 4 * rr FROM e
  UNION ALL SELECT cluster_level, g, 'gross_roi_pct', 'taker', roi_t, tt FROM e UNION ALL SELECT cluster_level, g, 'gross_roi_pct', 'maker', roi_m, mm FROM e UNION ALL SELECT cluster_level, g, 'gross_roi_pct', 'maker - taker', roi_m - roi_t, dd FROM e),
s AS (SELECT *, sqrt(g / (g - 1.0) * ss) AS se FROM r), z AS (SELECT *, round(v / nullif(se, 0), 5) AS z FROM s)
SELECT cluster_level, g AS clusters, metric, comparison, round(100 * v, 6) AS estimate, round(100 * se, 6) AS se, round(100 * (v - 1.96 * se), 6) AS ci_low, round(100 * (v + 1.96 * se), 6) AS ci_high, round({normal_sql('z')}, 5) AS p_value FROM z"""


@query("clustered_role_estimates", _LEVELS)
def clustered_role_estimates(spark, sf_dir):
    """Mispricing and gross return of takers, makers and their paired gap, with errors by market and by event clusters.

    One aggregation by market gives all sums: a maker's error is the taker's negated, and a cluster's influence is its sum
    less its executions times the mean. Events are sums of their markets.
    """
    p = joined(spark, sf_dir).selectExpr("ticker", "event_id", "CASE WHEN side = 'yes' THEN yes_price ELSE no_price END / 100d AS p", "cast(side = result AS int) AS won")
    m = p.groupBy("ticker").agg(F.first("event_id").alias("event_id"), F.count(F.lit(1)).cast("double").alias("n"), F.expr("sum(won - p)").alias("res"), F.expr("sum((won - p) / p)").alias("roi_t"), F.expr("sum((p - won) / (1 - p))").alias("roi_m"))
    sums = ["n", "res", "roi_t", "roi_m"]
    u = m.selectExpr("'market' AS cluster_level", *sums).union(m.groupBy("event_id").agg(*[F.sum(c).alias(c) for c in sums]).selectExpr("'event'", *sums))
    t = u.groupBy("cluster_level").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("tn"), *[F.expr(f"sum({c}) / sum(n)").alias(f"t_{c}") for c in sums[1:]])
    i = u.join(F.broadcast(t), "cluster_level").selectExpr("cluster_level", "g", *[f"t_{c}" for c in sums[1:]], *[f"({c} - n * t_{c}) / tn AS i_{c}" for c in sums[1:]])  # two rows on the right
    e = i.groupBy("cluster_level", "g", *[f"t_{c}" for c in sums[1:]]).agg(*[F.expr(f"sum({x} * {x})").alias(k) for k, x in (("rr", "i_res"), ("tt", "i_roi_t"), ("mm", "i_roi_m"), ("dd", "(i_roi_m - i_roi_t)"))])
    rows = "stack(6, 'mispricing_pp', 'taker', t_res, rr, 'mispricing_pp', 'maker', -t_res, rr, 'mispricing_pp', 'maker - taker', -2 * t_res, 4 * rr, 'gross_roi_pct', 'taker', t_roi_t, tt, 'gross_roi_pct', 'maker', t_roi_m, mm, 'gross_roi_pct', 'maker - taker', t_roi_m - t_roi_t, dd) AS (metric, comparison, v, ss)"
    s = e.selectExpr("cluster_level", "g AS clusters", rows).selectExpr("*", "sqrt(clusters / (clusters - 1d) * ss) AS e")
    z = s.selectExpr("*", "round(v / nullif(e, 0d), 5) AS z")
    return z.select("cluster_level", "clusters", "metric", "comparison", *[F.expr(f"round({x}, 6)").alias(k) for k, x in (("estimate", "100 * v"), ("se", "100 * e"), ("ci_low", "100 * (v - 1.96d * e)"), ("ci_high", "100 * (v + 1.96d * e)"))], F.round(normal_two_sided("z"), 5).alias("p_value"))


#: What the summary takes of each test: (query, [(metric, SQL over its rows)]). The SQL is read alike by both engines.
_SUMMARY = (
    ("mann_whitney_p_values", [("bands", "count(*)"), ("significant", "coalesce(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END), 0)")]),
    ("yes_no_asymmetry", [("prices", "count(*)"), ("significant", "coalesce(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END), 0)"), ("no_better", "coalesce(sum(CASE WHEN no_better THEN 1 ELSE 0 END), 0)"), ("largest_z", "max(abs(z_statistic))")]),
    ("welch_p_values", [("groups", "count(*)"), ("significant", "coalesce(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END), 0)"), ("largest_t", "max(abs(t))")]),
    ("size_correlations", [("pearson_r", "max(CASE WHEN kind = 'pearson' THEN r END)"), ("pearson_p", "max(CASE WHEN kind = 'pearson' THEN p_value END)"), ("spearman_r", "max(CASE WHEN kind = 'spearman' THEN r END)"), ("spearman_p", "max(CASE WHEN kind = 'spearman' THEN p_value END)")]),
    ("size_fit", [("slope_pp_per_log10", "max(slope_pp_per_log10)"), ("r_squared", "max(r_squared)")]),
    ("maker_direction_by_range", [("ranges", "count(*)"), ("significant", "coalesce(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END), 0)"), ("no_better", "coalesce(sum(CASE WHEN no_better THEN 1 ELSE 0 END), 0)"), ("largest_t", "max(abs(t))")]),
)


@query("statistical_tests", " UNION ALL ".join(f"SELECT '{name}' AS test, '{metric}' AS metric, CAST({x} AS DOUBLE) AS value FROM ({ORACLE_SQL[name]}) r" for name, parts in _SUMMARY for metric, x in parts), views=False)
def statistical_tests(spark, sf_dir):
    """The outcome of every test as one table: test, metric, value."""
    out = None
    for name, parts in _SUMMARY:
        row = QUERIES[name](spark, sf_dir).agg(*[F.expr(f"cast({x} AS double)").alias(m) for m, x in parts])
        rows = row.selectExpr(f"stack({len(parts)}, " + ", ".join(f"'{m}', {m}" for m, _ in parts) + ") AS (metric, value)").select(F.lit(name).alias("test"), "metric", "value")
        out = rows if out is None else out.union(rows)
    return out
