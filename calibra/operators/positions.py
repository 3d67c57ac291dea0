"""Dual positions and sufficient-statistic cells.

A trade is two positions: the taker's, and the maker's at the complementary price. Trades are first brought down to
cells (price, side, outcome and whatever the query slices by) with map-side aggregation, right after the join; the two
positions are then made of the cells by one pass of stack(), so nothing fact-sized is scanned or joined twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.sources import adapter


def joined(spark: SparkSession, sf_dir: str, finalized: bool = True) -> DataFrame:
    """Trades of resolved markets. The optimiser broadcasts the markets if they are small, and splits hot tickers if not."""
    return adapter.trades(spark, sf_dir).join(adapter.resolved(spark, sf_dir, finalized).select("ticker", "event_id", "result"), "ticker")


def cells(trades: DataFrame, *dims: str) -> DataFrame:
    """n trades, their contracts and squared contracts, by dims, price, side and outcome."""
    return trades.groupBy(*dims, "yes_price", "side", "result").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("contracts"))


def dual(cells: DataFrame, *dims: str) -> DataFrame:
    """(dims, n, contracts, role, direction, price, won): each cell as its taker's and its maker's position."""
    stacked = """stack(2,
      'taker', side, CASE WHEN side = 'yes' THEN yes_price ELSE 100 - yes_price END, cast(side = result AS int),
      'maker', CASE WHEN side = 'yes' THEN 'no' ELSE 'yes' END, CASE WHEN side = 'yes' THEN 100 - yes_price ELSE yes_price END, cast(side <> result AS int)
    ) AS (role, direction, price, won)"""
    return cells.selectExpr(*dims, "n", "contracts", stacked)


def positions(spark: SparkSession, sf_dir: str, *dims: str, finalized: bool = True) -> DataFrame:
    return dual(cells(joined(spark, sf_dir, finalized), *dims), *dims)
