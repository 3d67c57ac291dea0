"""Hypothesis tests, clustered errors, text rules and vectors."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.functions.buckets import equal_width
from calibra.operators.positions import cells, dual, joined, positions
from calibra.operators.resample import resampled_sums
from calibra.plans.base import query
from calibra.plans.market import customers, splits
from calibra.sources import adapter
from calibra.sources.adapter import table


@query("yes_no_ztest", """, g AS (SELECT price, direction, sum(cnt) AS n, sum(cnt * won) AS w FROM positions WHERE price % 5 = 0 AND price BETWEEN 5 AND 95 GROUP BY ALL),
j AS (SELECT y.price, y.n AS n1, y.w AS w1, o.n AS n2, o.w AS w2 FROM g y JOIN g o ON y.price = o.price AND y.direction = 'yes' AND o.direction = 'no' WHERE y.n >= 100 AND o.n >= 100),
p AS (SELECT *, (w1 + w2) * 1.0 / (n1 + n2) AS q FROM j)
SELECT price, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round((w1 * 1.0 / n1 - w2 * 1.0 / n2) / nullif(sqrt(q * (1.0 - q) * (1.0 / n1 + 1.0 / n2)), 0), 6) AS z FROM p""")
def yes_no_ztest(spark, sf_dir):
    of = lambda d, x: F.sum(F.when(F.col("direction") == d, F.expr(x)))
    g = positions(spark, sf_dir).where("price % 5 = 0 AND price BETWEEN 5 AND 95").groupBy("price").agg(of("yes", "contracts").alias("n1"), of("yes", "contracts * won").alias("w1"), of("no", "contracts").alias("n2"), of("no", "contracts * won").alias("w2"))
    p = g.where("n1 >= 100 AND n2 >= 100").selectExpr("*", "(w1 + w2) * 1d / (n1 + n2) AS q")
    return p.selectExpr("price", "n1", "n2", "round((w1 * 1d / n1 - w2 * 1d / n2) / nullif(sqrt(q * (1d - q) * (1d / n1 + 1d / n2)), 0d), 6) AS z")


@query("mann_whitney", """, x AS (SELECT CAST(floor((price - 1) / 10.0) AS INTEGER) AS band, role, 100 * won - price AS v FROM positions WHERE price BETWEEN 1 AND 99),
f AS (SELECT band, v, count(*) FILTER (role = 'maker') AS a, count(*) AS c FROM x GROUP BY band, v), r AS (SELECT *, sum(c) OVER (PARTITION BY band ORDER BY v) - c + (c + 1) / 2.0 AS rk FROM f),
s AS (SELECT band, sum(a) AS n1, sum(c) - sum(a) AS n2, sum(a * rk) - sum(a) * (sum(a) + 1) / 2.0 AS u, sum(pow(c * 1.0, 3) - c) AS ties, sum(c) AS n FROM r GROUP BY band)
SELECT band, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(u AS DOUBLE) AS u, round(1.0 - 2.0 * u / (n1 * 1.0 * n2), 8) AS effect,
  round((u - n1 * 1.0 * n2 / 2.0 - 0.5) / nullif(sqrt(n1 * 1.0 * n2 / 12.0 * (n + 1.0 - ties / (n * (n - 1.0)))), 0), 6) AS z FROM s WHERE n1 >= 100 AND n2 >= 100""")
def mann_whitney(spark, sf_dir):
    """Tie-averaged ranks from value frequencies: a band has two hundred values at most, however many trades it has."""
    f = positions(spark, sf_dir).where(F.col("price").between(1, 99)).selectExpr("cast(floor((price - 1) / 10d) AS int) AS band", "role", "100 * won - price AS v", "n").groupBy("band", "v").agg(F.sum(F.when(F.col("role") == "maker", F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("c"))
    r = f.withColumn("rk", F.sum("c").over(Window.partitionBy("band").orderBy("v")) - F.col("c") + (F.col("c") + 1) / F.lit(2.0))
    s = r.groupBy("band").agg(F.sum("a").alias("n1"), F.expr("sum(c) - sum(a)").alias("n2"), F.expr("sum(a * rk) - sum(a) * (sum(a) + 1) / 2d").alias("u"), F.expr("sum(pow(c * 1d, 3d) - c)").alias("ties"), F.sum("c").alias("n")).where("n1 >= 100 AND n2 >= 100")
    return s.selectExpr("band", "n1", "n2", "u", "round(1d - 2d * u / (n1 * 1d * n2), 8) AS effect", "round((u - n1 * 1d * n2 / 2d - 0.5d) / nullif(sqrt(n1 * 1d * n2 / 12d * (n + 1d - ties / (n * (n - 1d)))), 0d), 6) AS z")


_WELCH = """, v AS (SELECT k.segment, 100 * won - price AS x FROM positions p JOIN customers k USING (event_id) WHERE role = 'maker'), g AS (SELECT segment, count(*) AS n, avg(x * 1.0) AS m, var_samp(x * 1.0) AS s FROM v GROUP BY segment),
b AS (SELECT g.segment, g.n, g.m - h.m AS d, g.s / g.n AS e1, h.s / h.n AS e2, g.n AS n1, h.n AS n2, sqrt(((g.n - 1) * g.s + (h.n - 1) * h.s) / (g.n + h.n - 2)) AS pooled FROM g JOIN g h ON h.segment = 'BUILDING' AND g.segment <> 'BUILDING' WHERE g.n >= 100)
SELECT segment, n, round(d / sqrt(e1 + e2), 6) AS t, round(pow(e1 + e2, 2) / (pow(e1, 2) / (n1 - 1) + pow(e2, 2) / (n2 - 1)), 4) AS dof, round(CASE WHEN pooled = 0 THEN 0 ELSE d / pooled END, 8) AS cohens_d FROM b"""


@query("welch", _WELCH)
def welch(spark, sf_dir):
    """Each segment's maker returns against one segment's; means and variances from cells."""
    c = dual(cells(joined(spark, sf_dir), "event_id"), "event_id").where("role = 'maker'").join(customers(spark, sf_dir).select("event_id", "segment"), "event_id").withColumn("x", F.expr("100 * won - price"))
    g = c.groupBy("segment").agg(F.sum("n").alias("n"), F.expr("sum(n * x)").alias("s1"), F.expr("sum(n * x * x)").alias("s2")).selectExpr("segment", "n", "s1 * 1d / n AS m", "(s2 - s1 * 1d * s1 / n) / (n - 1) AS s")
    h = g.where("segment = 'BUILDING'").selectExpr("n AS n2", "m AS m2", "s AS s2")
    b = g.where("segment <> 'BUILDING' AND n >= 100").crossJoin(h).selectExpr("segment", "n", "n2", "m - m2 AS d", "s / n AS e1", "s2 / n2 AS e2", "sqrt(((n - 1) * s + (n2 - 1) * s2) / (n + n2 - 2)) AS pooled")  # one row on the right
    return b.selectExpr("segment", "n", "round(d / sqrt(e1 + e2), 6) AS t", "round(pow(e1 + e2, 2d) / (pow(e1, 2d) / (n - 1) + pow(e2, 2d) / (n2 - 1)), 4) AS dof", "round(CASE WHEN pooled = 0 THEN 0d ELSE d / pooled END, 8) AS cohens_d")


@query("direction_welch", """, v AS (SELECT direction, least(cnt, 100) AS w, won - price / 100.0 AS x FROM positions WHERE role = 'maker'), g AS (SELECT direction, sum(w) AS n, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS q FROM v GROUP BY direction),
s AS (SELECT *, (q - m * m) * n / (n - 1.0) AS s FROM g) SELECT CAST(y.n AS BIGINT) AS n_yes, CAST(o.n AS BIGINT) AS n_no, round((y.m - o.m) / sqrt(y.s / y.n + o.s / o.n), 5) AS t FROM s y, s o WHERE y.direction = 'yes' AND o.direction = 'no'""")
def direction_welch(spark, sf_dir):
    """Weighted moments in place of rows repeated by count and sampled: exact and the same each time."""
    t = joined(spark, sf_dir).selectExpr("CASE WHEN side = 'yes' THEN 'no' ELSE 'yes' END AS direction", "least(cnt, 100) AS w", "cast(side <> result AS int) - (CASE WHEN side = 'yes' THEN no_price ELSE yes_price END) / 100d AS x")
    g = t.groupBy("direction").agg(F.sum("w").alias("n"), F.expr("sum(w * x) / sum(w)").alias("m"), F.expr("sum(w * x * x) / sum(w)").alias("q")).selectExpr("direction", "n", "m", "(q - m * m) * n / (n - 1d) AS s")
    wide = g.groupBy().pivot("direction", ["yes", "no"]).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("s").alias("s"))
    return wide.selectExpr("yes_n AS n_yes", "no_n AS n_no", "round((yes_m - no_m) / sqrt(yes_s / yes_n + no_s / no_n), 5) AS t")


@query("correlations", """, c AS (SELECT price, cnt, (100 * won - price) * 1.0 AS x FROM positions), rp AS (SELECT price, sum(count(*)) OVER (ORDER BY price) - count(*) + (count(*) + 1) / 2.0 AS r FROM c GROUP BY price), rc AS (SELECT cnt, sum(count(*)) OVER (ORDER BY cnt) - count(*) + (count(*) + 1) / 2.0 AS r FROM c GROUP BY cnt)
SELECT round(corr(price * 1.0, cnt * 1.0), 7) AS pearson_price_size, round(corr(cnt * 1.0, x), 7) AS pearson_size_return, round(corr(rp.r, rc.r), 7) AS spearman_price_size, count(*) AS n FROM c JOIN rp USING (price) JOIN rc USING (cnt)""")
def correlations(spark, sf_dir):
    """Pearson and Spearman over the whole table: (price, size, return) frequencies first, ranks of the few distinct values next."""
    t = joined(spark, sf_dir).selectExpr("cnt", "stack(2, CASE WHEN side = 'yes' THEN yes_price ELSE no_price END, cast(side = result AS int), CASE WHEN side = 'yes' THEN no_price ELSE yes_price END, cast(side <> result AS int)) AS (price, won)")
    c = t.groupBy("price", "cnt", "won").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.expr("(100 * won - price) * 1d"))
    rank = lambda k: c.groupBy(k).agg(F.sum("n").alias("m")).select(k, (F.sum("m").over(Window.orderBy(k)) - F.col("m") + (F.col("m") + 1) / F.lit(2.0)).alias(f"r_{k}"))
    c = c.join(rank("price"), "price", "left").join(rank("cnt"), "cnt", "left")  # left: no null filters on one side alone, so the cells' shuffle is shared
    moments = lambda a, b: f"(sum(n * {a} * {b}) * sum(n) - sum(n * {a}) * sum(n * {b})) / (sqrt(sum(n * {a} * {a}) * sum(n) - pow(sum(n * {a}), 2d)) * sqrt(sum(n * {b} * {b}) * sum(n) - pow(sum(n * {b}), 2d)))"
    c = c.selectExpr("cast(n AS double) AS n", "cast(price AS double) AS p", "cast(cnt AS double) AS s", "x", "r_price / 1e3d AS rp", "r_cnt / 1e3d AS rc")
    return c.agg(F.expr(f"round({moments('p', 's')}, 7)").alias("pearson_price_size"), F.expr(f"round({moments('s', 'x')}, 7)").alias("pearson_size_return"), F.expr(f"round({moments('rp', 'rc')}, 7)").alias("spearman_price_size"), F.expr("cast(sum(n) AS bigint)").alias("n"))


@query("binned_fit", """, r AS (SELECT min(price) AS a, max(price) AS b FROM positions), g AS (SELECT CAST(greatest(1, ceil((price - a) / ((b - a) / 20.0))) AS INTEGER) AS bin, count(*) AS n, avg(price * 1.0) AS x, avg(100.0 * won) AS y FROM positions, r GROUP BY 1),
s AS (SELECT sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sum(n * x * y) / sum(n) AS mxy, sum(n * x * x) / sum(n) AS mxx FROM g), f AS (SELECT (mxy - mx * my) / (mxx - mx * mx) AS slope, my - (mxy - mx * my) / (mxx - mx * mx) * mx AS intercept FROM s),
w AS (SELECT sum(sqrt(n) * y) / sum(sqrt(n)) AS my FROM g)
SELECT round(slope, 7) AS slope, round(intercept, 6) AS intercept, round(1.0 - sum(sqrt(n) * pow(y - slope * x - intercept, 2)) / sum(sqrt(n) * pow(y - my, 2)), 7) AS r2, count(*) AS bins FROM g, f, w GROUP BY slope, intercept""")
def binned_fit(spark, sf_dir):
    p = positions(spark, sf_dir).groupBy("price").agg(F.sum("n").alias("n"), F.expr("sum(n * won)").alias("won"))
    p = p.withColumns({"a": F.min("price").over(Window.partitionBy()), "b": F.max("price").over(Window.partitionBy())})  # 99 rows
    g = p.groupBy(equal_width(F.col("price"), F.col("a"), F.col("b"), 20).alias("bin")).agg(F.sum("n").alias("n"), F.expr("sum(n * price) * 1d / sum(n)").alias("x"), F.expr("sum(won) * 100d / sum(n)").alias("y"))
    s = g.agg(*[F.expr(f"sum(n * {e}) / sum(n)").alias(k) for k, e in (("mx", "x"), ("my", "y"), ("mxy", "x * y"), ("mxx", "x * x"))], F.expr("sum(sqrt(n) * y) / sum(sqrt(n))").alias("wy"))
    f = s.selectExpr("(mxy - mx * my) / (mxx - mx * mx) AS slope", "mx", "my", "wy").selectExpr("slope", "my - slope * mx AS intercept", "wy")
    j = g.crossJoin(f)
    return j.groupBy("slope", "intercept").agg(F.expr("round(1d - sum(sqrt(n) * pow(y - slope * x - intercept, 2d)) / sum(sqrt(n) * pow(y - wy, 2d)), 7)").alias("r2"), F.count(F.lit(1)).alias("bins")).withColumns({"slope": F.round("slope", 7), "intercept": F.round("intercept", 6)})


def clustered(spark, sf_dir, key):
    """Paired maker less taker mispricing, with the error of influence sums by cluster.

    A maker has what its taker loses, on as many contracts: the taker's sums by cluster give both sides.
    """
    won = F.expr("100 * cast(side = result AS int) - CASE WHEN side = 'yes' THEN yes_price ELSE no_price END")
    c = joined(spark, sf_dir).groupBy(key).agg(F.sum("cnt").alias("w"), F.sum(F.col("cnt") * won).alias("s"))
    t = c.agg(F.sum("w").cast("double").alias("tw"), F.sum("s").cast("double").alias("ts"))
    j = c.crossJoin(F.broadcast(t)).selectExpr("ts / tw AS mt", "2d * (s - w * (ts / tw)) / tw AS influence")  # one row of totals
    return j.groupBy("mt").agg(F.count(F.lit(1)).alias("clusters"), F.expr("sum(influence * influence)").alias("ss")).selectExpr("clusters", "round(-mt, 8) AS maker", "round(mt, 8) AS taker", "round(-2 * mt, 8) AS gap", "round(sqrt(clusters / (clusters - 1d) * ss), 8) AS se")


def _clustered(key: str) -> str:
    return f""", c AS (SELECT {key}, coalesce(sum(cnt) FILTER (role = 'maker'), 0) AS mw, coalesce(sum(cnt * (100 * won - price)) FILTER (role = 'maker'), 0) AS ms, coalesce(sum(cnt) FILTER (role = 'taker'), 0) AS tw, coalesce(sum(cnt * (100 * won - price)) FILTER (role = 'taker'), 0) AS ts FROM positions GROUP BY {key}),
t AS (SELECT sum(mw) * 1.0 AS mw, sum(tw) * 1.0 AS tw, sum(ms) * 1.0 / sum(mw) AS mm, sum(ts) * 1.0 / sum(tw) AS mt FROM c)
SELECT count(*) AS clusters, round(any_value(mm), 8) AS maker, round(any_value(mt), 8) AS taker, round(any_value(mm - mt), 8) AS gap, round(sqrt(count(*) / (count(*) - 1.0) * sum(pow((c.ms - c.mw * mm) / t.mw - (c.ts - c.tw * mt) / t.tw, 2))), 8) AS se FROM c, t"""


query("clustered_se_market", _clustered("ticker"))(lambda spark, sf_dir: clustered(spark, sf_dir, "ticker"))
query("clustered_se_event", _clustered("event_id"))(lambda spark, sf_dir: clustered(spark, sf_dir, "event_id"))


@query("event_bootstrap")
def event_bootstrap(spark, sf_dir, repetitions: int = 2000, seed: int = 340):
    """Percentile interval of the loss difference of the price and the constant 0.5 when whole events are drawn again; see
    model_comparison for two models on held-out events."""
    loss = {"base": "sum(contracts * pow(won - price / 100d, 2d))", "flat": "sum(contracts * pow(won - 0.5d, 2d))"}
    e = positions(spark, sf_dir, "event_id").groupBy("event_id").agg(*[F.expr(x).alias(k) for k, x in loss.items()], F.sum("contracts").alias("w"))
    d = resampled_sums(e, "event_id", ["base", "flat", "w"], repetitions, seed).select(((F.col("base") - F.col("flat")) / F.col("w")).alias("d"))
    return d.agg(F.expr("percentile(d, 0.025d)").alias("low"), F.expr("percentile(d, 0.975d)").alias("high"), F.avg("d").alias("mean"), F.count(F.lit(1)).alias("repetitions"))


_BRIER = """, split AS (SELECT ticker, CAST('0x' || substr(md5('340:' || coalesce(event_id, ticker)), 1, 8) AS BIGINT) % 100 AS bucket FROM markets), j AS (SELECT CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 90 THEN 'test' ELSE 'validation' END AS split, result, cnt, yes_price, CAST(result = 'yes' AS INTEGER) AS won FROM joined JOIN split USING (ticker))
SELECT split, result, CAST(sum(cnt) AS BIGINT) AS w, sum(cnt * (100 * won - yes_price) * (100 * won - yes_price)) / (10000.0 * sum(cnt)) AS brier FROM j GROUP BY split, result"""


@query("brier_by_split", _BRIER)
def brier_by_split(spark, sf_dir):
    c = joined(spark, sf_dir).groupBy("ticker", "result", "yes_price").agg(F.sum("cnt").alias("w")).withColumn("sq", F.expr("w * pow(100 * cast(result = 'yes' AS int) - yes_price, 2)").cast("long"))
    return c.join(splits(spark, sf_dir).select("ticker", "split"), "ticker").groupBy("split", "result").agg(F.sum("w").alias("w"), F.expr("sum(sq)").alias("sq")).selectExpr("split", "result", "w", "sq / (10000d * w) AS brier")


@query("reliability_curve", """, q AS (SELECT CAST(least(floor(10 * (yes_price / 100.0)), 9) AS INTEGER) AS bin, sum(cnt) AS w, sum(cnt * yes_price) AS p, sum(cnt * CAST(result = 'yes' AS INTEGER)) AS o FROM joined GROUP BY 1) SELECT bin, CAST(w AS BIGINT) AS w, p / (100.0 * w) AS predicted, o * 1.0 / w AS observed FROM q""")
def reliability_curve(spark, sf_dir):
    c = joined(spark, sf_dir).groupBy(F.expr("cast(least(floor(10 * (yes_price / 100d)), 9) AS int)").alias("bin")).agg(F.sum("cnt").alias("w"), F.expr("sum(cnt * yes_price)").alias("p"), F.expr("sum(cnt * cast(result = 'yes' AS int))").alias("o"))
    return c.selectExpr("bin", "w", "p / (100d * w) AS predicted", "o * 1d / w AS observed")


@query("rule_attributes", "SELECT CASE WHEN regexp_matches(p_name, '\\b(red|blue|green)\\b') THEN 'colour' WHEN regexp_matches(p_name, '\\b(small|large|big)\\b') THEN 'size' WHEN starts_with(p_name, 'hot') THEN 'heat' ELSE 'other' END AS domain, regexp_extract(p_name, '([a-z]+)$', 1) AS underlying, count(*) AS n FROM part GROUP BY ALL", views=False)
def rule_attributes(spark, sf_dir):
    name = F.col("p_name")
    domain = F.when(name.rlike(r"\b(red|blue|green)\b"), "colour").when(name.rlike(r"\b(small|large|big)\b"), "size").when(name.startswith("hot"), "heat").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(domain.alias("domain"), F.regexp_extract("p_name", "([a-z]+)$", 1).alias("underlying")).agg(F.count(F.lit(1)).alias("n"))


@query("tfidf_terms", """, t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), n AS (SELECT count(*) AS n FROM part), d AS (SELECT term, count(DISTINCT p_partkey) AS df FROM t GROUP BY term HAVING count(DISTINCT p_partkey) >= 2) SELECT term, df, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 8) AS idf FROM d, n""")
def tfidf_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    return d.crossJoin(p.agg(F.count(F.lit(1)).alias("n"))).selectExpr("term", "df", "round(ln((1d + n) / (1d + df)) + 1d, 8) AS idf")


_CENTRES = """, x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i), l AS (SELECT label, sqrt(sum(v * v)) AS l FROM c GROUP BY label)
"""


@query("cluster_centres", _CENTRES + "SELECT label, CAST(i AS INTEGER) AS i, round(v / l, 7) AS v FROM c JOIN l USING (label)")
def cluster_centres(spark, sf_dir):
    return centres(spark, sf_dir).select("label", F.posexplode("c").alias("k", "x")).selectExpr("label", "k + 1 AS i", "round(x, 7) AS v")


def centres(spark, sf_dir):
    """Normalised mean vector of each label."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    c = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v))
    return c.select("label", F.transform("c", lambda v: v / norm).alias("c"))


@query("nearest_centre", _CENTRES + """, s AS (SELECT x.vec_id, x.label, c.label AS nearest, sum(x.v * c.v / l.l) AS sim FROM x JOIN c ON c.i = x.i JOIN l ON l.label = c.label GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nearest DESC) AS nth FROM s)
SELECT vec_id, label, nearest, round(sim, 6) AS similarity, CASE WHEN sim >= 0.3 THEN 'assigned' ELSE 'distant' END AS status FROM b WHERE nth = 1""")
def nearest_centre(spark, sf_dir, least: float = 0.3):
    """Each vector's most similar centre and a status; the centres, a row a label, are few."""
    c = F.broadcast(centres(spark, sf_dir).groupBy().agg(F.collect_list(F.struct("label", "c")).alias("cs")))
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "cast(embedding AS array<double>) AS v").crossJoin(c)
    dot = F.transform("cs", lambda s: F.struct(F.aggregate(F.zip_with("v", s["c"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("sim"), s["label"].alias("label")))
    best = F.array_max(dot)
    return e.select("vec_id", "label", best["label"].alias("nearest"), F.round(best["sim"], 6).alias("similarity"), F.when(best["sim"] >= least, "assigned").otherwise("distant").alias("status"))
