"""Weighted ridge regression of a price's error, on powers of the price and on categories.

Spark sums the packed triangle of (1, p, p^2, p^3, error) by category; the normal equations of every feature set and their
solutions come from these sums. Candidates are scored and rows predicted in one pass each, on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
DEGREE = 3
#: Categories and their combinations that a fit may have: the size of a model, so an error, not a cut.
MOST = 20_000


@dataclass
class Model:
    """p plus this, cut to 0..1: intercept + sum of powers + an offset for each category's value, nothing for values not seen in training."""

    name: str
    alpha: float
    intercept: float
    powers: np.ndarray
    offsets: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def features(self) -> int:
        return len(self.powers) + sum(map(len, self.offsets.values()))


def moments(cells: DataFrame, categories: tuple[str, ...], degree: int = DEGREE) -> DataFrame:
    """A row for each combination of ``categories``: rows, and the weighted sums of products of (1, p, ... p^degree, error)."""
    parts = ["1d", *[f"pow(price, {k}d)" for k in range(1, degree + 1)], "(outcome - price)"]
    sums = [F.expr(f"sum(n * {parts[i]} * {parts[j]})").alias(f"m_{i}_{j}") for i, j in combinations_with_replacement(range(len(parts)), 2)]
    return cells.groupBy(*categories).agg(F.count(F.lit(1)).alias("rows"), *sums)


def triangles(rows: list, size: int) -> np.ndarray:
    out = np.zeros((len(rows), size, size))
    for i, j in combinations_with_replacement(range(size), 2):
        out[:, i, j] = out[:, j, i] = [r[f"m_{i}_{j}"] for r in rows]
    return out


def solve(rows: list, name: str, categories: tuple[str, ...], alphas: tuple[float, ...], degree: int = DEGREE) -> list[Model]:
    """A model for each alpha, from the rows of ``moments``.

    Powers are brought to weighted mean 0 and variance 1, categories stay 0 or 1, the intercept is free, weights have
    mean 1 over the cells. A category's values meet only through the cells that they share, so the equations are
    filled from the sums of the combinations.
    """
    t = triangles(rows, degree + 2)
    scale = sum(r["rows"] for r in rows) / t[:, 0, 0].sum()
    t *= scale
    whole = t.sum(axis=0)
    weight, mean, last = whole[0, 0], whole[0, 1:-1] / whole[0, 0], whole[0, -1] / whole[0, 0]
    spread = np.sqrt(np.maximum(np.diag(whole)[1:-1] / weight - mean**2, 0))
    spread[spread == 0] = 1
    values = {c: sorted({r[c] for r in rows if r[c] is not None}) for c in categories}
    start, place = degree, {}
    for c in categories:
        place[c] = {v: start + k for k, v in enumerate(values[c])}
        start += len(values[c])
    a, b, centre = np.zeros((start, start)), np.zeros(start), np.zeros(start)
    a[:degree, :degree], b[:degree], centre[:degree] = whole[1:-1, 1:-1], whole[1:-1, -1], mean
    for r, own in zip(rows, t, strict=True):
        at = [place[c][r[c]] for c in categories if r[c] is not None]
        for i in at:
            b[i] += own[0, -1]
            centre[i] += own[0, 0] / weight
            a[i, :degree] += own[0, 1:-1]
            a[:degree, i] += own[0, 1:-1]
            for j in at:
                a[i, j] += own[0, 0]
    unit = np.ones(start)
    unit[:degree] = 1 / spread
    a = (a - weight * np.outer(centre, centre)) * np.outer(unit, unit)
    b = (b - weight * centre * last) * unit
    models = []
    for alpha in alphas:
        beta = np.linalg.solve(a + alpha * np.eye(start), b) * unit
        offsets = {c: {v: float(beta[k]) for v, k in place[c].items()} for c in categories}
        models.append(Model(name, alpha, float(last - beta @ centre), beta[:degree], offsets))
    return models


def fit(cells: DataFrame, sets: dict[str, tuple[str, ...]], alphas: tuple[float, ...] = ALPHAS, most: int = MOST) -> list[Model]:
    """Models of every feature set and alpha, fitted on the rows of ``cells`` (split, price, outcome, n, categories) whose split is 'train'.

    A null category counts as none. One aggregation serves all sets; its rows, one for each combination of categories in
    training, come to the driver; more than ``most`` are an error.
    """
    named = tuple(dict.fromkeys(c for s in sets.values() for c in s))
    rows = moments(cells.where("split = 'train'"), named).limit(most + 1).collect()
    if not rows or not any(r["m_0_0"] for r in rows):
        raise ValueError("no weight in training")
    if len(rows) > most:
        raise ValueError(f"more than {most} combinations of {', '.join(named)}")
    return [m for name, categories in sets.items() for m in solve(rows, name, categories, alphas)]


def predictions(cells: DataFrame, models: dict[str, Model]) -> DataFrame:
    """cells with a column of predictions for each model: the price and its correction, cut to 0..1.

    Offsets are joined by category. Their tables have a row a value of training, at most ``MOST``, so they may be broadcast.
    """
    out = cells
    for c in dict.fromkeys(c for m in models.values() for c in m.offsets):
        holders = [k for k, m in models.items() if c in m.offsets]
        values = sorted({v for k in holders for v in models[k].offsets[c]})
        rows = [(v, *[models[k].offsets[c].get(v, 0.0) for k in holders]) for v in values]
        ddl = ", ".join([f"`__v_{c}` string", *[f"`__o_{c}_{k}` double" for k in holders]])
        table = cells.sparkSession.createDataFrame(rows, ddl)
        out = out.join(F.broadcast(table), out[c].cast("string") == table[f"__v_{c}"], "left").drop(f"__v_{c}")

    def predicted(k: str, m: Model) -> Column:
        total = F.lit(m.intercept)
        for power, x in enumerate(m.powers, 1):
            total = total + F.lit(float(x)) * F.pow("price", F.lit(float(power)))
        for c in m.offsets:
            total = total + F.coalesce(F.col(f"`__o_{c}_{k}`"), F.lit(0.0))
        return F.least(F.greatest(F.col("price") + total, F.lit(0.0)), F.lit(1.0))

    return out.select(*cells.columns, *[predicted(k, m).alias(k) for k, m in models.items()])


def brier(cells: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """The weighted mean squared error of each column, by the columns ``by``."""
    loss = [F.expr(f"sum(n * pow(outcome - `{c}`, 2d)) / sum(n)").alias(c) for c in columns]
    return cells.groupBy(*by).agg(F.sum("n").alias("w"), *loss)


def choose(cells: DataFrame, models: list[Model]) -> dict[str, tuple[Model, float]]:
    """For each feature set the model with the least error on the rows whose split is 'validation', the first of equals; all are scored in one pass."""
    names = {f"m{k}": m for k, m in enumerate(models)}
    scores = brier(predictions(cells.where("split = 'validation'"), names), list(names)).first()
    best: dict[str, tuple[Model, float]] = {}
    for k, m in names.items():
        if scores[k] is None:
            raise ValueError("no weight in validation")
        if m.name not in best or scores[k] < best[m.name][1]:
            best[m.name] = (m, scores[k])
    return best
