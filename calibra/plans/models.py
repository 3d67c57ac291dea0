"""Price corrections by ridge regression: fits, predictions of held-out cells, histograms, comparisons by event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.operators import ridge
from calibra.operators.resample import resampled_sums
from calibra.operators.stage import staged
from calibra.plans.base import query
from calibra.plans.market import customers, splits
from calibra.plans.textflow import assigned
from calibra.sources import adapter

#: Feature sets, each the shared price curve and these categories.
SETS = {"pooled": (), "structural": ("family",), "structural_text": ("family", "cluster")}
PAIRS = (("structural", "pooled"), ("structural_text", "pooled"), ("structural_text", "structural"), ("pooled", "price"))
BINS = 60


def market_cells(spark, sf_dir) -> DataFrame:
    """Resolved trades as cells: ticker, price, outcome, and n, the number of executions."""
    j = adapter.trades(spark, sf_dir).groupBy("ticker", "yes_price").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("contracts"))
    known = j.join(adapter.resolved(spark, sf_dir).select("ticker", "event_id", "result"), "ticker")
    return known.selectExpr("ticker", "event_id", "yes_price / 100d AS price", "cast(result = 'yes' AS double) AS outcome", "cast(n AS double) AS n", "contracts")


def labelled_cells(spark, sf_dir) -> DataFrame:
    """Cells with the split, family and text cluster of their contract; cells without a cluster share the name ''."""
    of = assigned(spark, sf_dir).select("ticker", "split", "family", F.coalesce("cluster", F.lit("")).alias("cluster"))
    return market_cells(spark, sf_dir).join(of, "ticker")


def fitted(spark, sf_dir):
    """(cells, chosen models by name with their validation error)."""
    cells = staged(labelled_cells(spark, sf_dir))
    return cells, ridge.choose(cells, ridge.fit(cells, SETS))


def held_out(spark, sf_dir) -> DataFrame:
    cells, best = fitted(spark, sf_dir)
    return ridge.predictions(cells.where("split <> 'train'"), {k: m for k, (m, _) in best.items()})


@query("model_sizes")
def model_sizes(spark, sf_dir):
    """Features, penalty and validation error of the model chosen for each feature set."""
    cells, best = fitted(spark, sf_dir)
    n = cells.where("split = 'train'").agg(F.count(F.lit(1)).alias("training_cells"))
    rows = [(k, m.features, m.alpha, error) for k, (m, error) in best.items()]
    return spark.createDataFrame(rows, "approach string, features int, alpha double, validation_brier double").crossJoin(n)  # one row on the right


@query("heldout_predictions")
def heldout_predictions(spark, sf_dir):
    """A row for every cell of validation and test, with the prediction of each model."""
    return held_out(spark, sf_dir)


@query("correction_histogram")
def correction_histogram(spark, sf_dir):
    """Share of validation executions by the size of the correction, in 60 bins that all models share."""
    each = held_out(spark, sf_dir).where("split = 'validation'").select("n", F.expr("stack(3, " + ", ".join(f"'{k}', 100 * ({k} - price)" for k in SETS) + ") AS (approach, x)"))
    values = staged(each.groupBy("approach", "x").agg(F.sum("n").alias("n")))  # a row a correction, not a row a cell
    span = values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / BINS
    placed = values.crossJoin(span).withColumn("bin", F.least(F.lit(BINS - 1), F.coalesce(F.floor((F.col("x") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(0)).cast("int")))  # one row
    found = placed.groupBy("approach", "bin").agg(F.sum("n").alias("n"))
    spine = span.select(F.explode(F.array(*[F.lit(k) for k in SETS])).alias("approach"), "low", "high").select("approach", "low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    total = values.where(F.col("approach") == next(iter(SETS))).agg(F.sum("n").alias("total"))  # every approach has all executions
    out = spine.join(found, ["approach", "bin"], "left").crossJoin(total)  # one row on the right
    return out.select("approach", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from_pp"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("to_pp"), (F.coalesce("n", F.lit(0.0)) / F.col("total")).alias("share"))


def compared(rows: DataFrame, pairs=PAIRS, repetitions: int = 2000, seed: int = 340) -> DataFrame:
    """rows (event_id, n, outcome, predictions) -> candidate, baseline, improvement in Brier score, its 95 % interval when whole
    events are drawn again, its sign, events."""
    loss = lambda c: f"n * pow(outcome - `{c}`, 2d)"
    names = [f"d{k}" for k in range(len(pairs))]
    sums = [F.expr(f"sum({loss(base)} - {loss(cand)})").alias(d) for d, (cand, base) in zip(names, pairs, strict=True)]
    blocks = staged(rows.groupBy("event_id").agg(F.sum("n").alias("w"), *sums))  # a row an event; read twice below
    stacked = lambda df, extra="": df.selectExpr(*([extra] if extra else []), f"stack({len(pairs)}, " + ", ".join(f"'{c}', '{b}', {d} / w" for d, (c, b) in zip(names, pairs, strict=True)) + ") AS (candidate, baseline, x)")
    draws = stacked(resampled_sums(blocks, "event_id", ["w", *names], repetitions, seed))
    spread = draws.groupBy("candidate", "baseline").agg(F.expr("percentile(x, 0.025d)").alias("ci_low"), F.expr("percentile(x, 0.975d)").alias("ci_high"))
    whole = stacked(blocks.agg(F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(c) for c in ("w", *names)]), "events").withColumnRenamed("x", "improvement")
    sign = F.when(F.col("ci_low") > 0, "better").when(F.col("ci_high") < 0, "worse").otherwise("unclear")
    return whole.join(spread, ["candidate", "baseline"]).select("candidate", "baseline", "improvement", "ci_low", "ci_high", sign.alias("sign"), "events")


@query("model_comparison")
def model_comparison(spark, sf_dir):
    return compared(held_out(spark, sf_dir).where("split = 'test'"))


@query("ridge_scores")
def ridge_scores(spark, sf_dir, alphas: tuple = (0.1, 1.0, 10.0, 100.0)):
    """Weighted ridge on the price's error over p, p^2, p^3 and the event's segment; alpha by validation error. Weights are contracts."""
    c = market_cells(spark, sf_dir).withColumn("n", F.col("contracts").cast("double"))
    c = c.join(splits(spark, sf_dir).select("ticker", "split"), "ticker").join(customers(spark, sf_dir).select("event_id", "segment"), "event_id")
    cells = c.groupBy("split", "segment", "price", "outcome").agg(F.sum("n").alias("n"))
    model, _ = ridge.choose(cells, ridge.fit(cells, {"segment": ("segment",)}, alphas))["segment"]
    scores = ridge.brier(ridge.predictions(cells, {"model": model}), ["model", "price"], "split")
    return scores.select("split", F.lit(model.alpha).alias("alpha"), F.col("model").alias("model_brier"), F.col("price").alias("market_brier"))
