"""Calibration as the state of a stream: wins and counts by price, and a timer for each week's end.

Each price keeps its totals so far and those of weeks that are still open. When the watermark passes a Sunday, its timer
takes the week into the totals and sends them on; the next Sunday's timer is set then, so a price has a row for every
week from its first on, with or without ticks. Ticks of a week that is closed are late and dropped by the watermark.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WEEKS = "price int, week_end date, n long, wins long"
DAY_MS = 86_400_000


def closing_ms(week_end: dt.date) -> int:
    """The end of the Sunday that ends a week, in milliseconds."""
    return (week_end - dt.date(1970, 1, 1)).days * DAY_MS + DAY_MS


class WeeklyTotals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, wins long")
        self.open = handle.getMapState("open", "week_end date", "n long, wins long")

    def handleInputRows(self, key, rows, timerValues):
        added: dict[dt.date, list[int]] = {}
        for pdf in rows:
            for week, own in pdf.groupby("week_end"):
                x = added.setdefault(week, [0, 0])
                x[0] += len(own)
                x[1] += int(own["won"].sum())
        fresh = not any(True for _ in self.handle.listTimers())
        for week, (n, wins) in added.items():
            had = self.open.getValue((week,)) if self.open.containsKey((week,)) else (0, 0)
            self.open.updateValue((week,), (had[0] + n, had[1] + wins))
        if fresh and added:
            self.handle.registerTimer(closing_ms(min(added)))
        elif added:
            first = min(self.handle.listTimers())
            if closing_ms(min(added)) < first:  # an older week that is still open
                self.handle.deleteTimer(first)
                self.handle.registerTimer(closing_ms(min(added)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Closes the timer's week and those after it that the watermark has passed as well."""
        at, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        n, wins = self.total.get() if self.total.exists() else (0, 0)
        rows = []
        while not rows or at < mark:
            week = dt.date(1970, 1, 1) + dt.timedelta(days=at // DAY_MS - 1)
            if self.open.containsKey((week,)):
                more = self.open.getValue((week,))
                n, wins = n + more[0], wins + more[1]
                self.open.removeKey((week,))
            rows.append((key[0], week, n, wins))
            at += 7 * DAY_MS
        self.total.update((n, wins))
        self.handle.registerTimer(at)
        yield pd.DataFrame(rows, columns=["price", "week_end", "n", "wins"])


def weekly_totals(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """ticks, a stream (ts, price, won), to (price, week_end, n, wins): cumulative, a row a price and closed week. Needs the RocksDB state store."""
    timed = ticks.select(F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("int").alias("price"), F.col("won").cast("int").alias("won")).withWatermark("ts", late)
    keyed = timed.withColumn("week_end", F.date_add(F.date_trunc("week", "ts").cast("date"), 6))
    return keyed.groupBy("price").transformWithStateInPandas(WeeklyTotals(), WEEKS, "append", "eventTime")


def deviation(totals: DataFrame, least: int = 1000) -> DataFrame:
    """(week_end, n, mean_absolute_deviation) of what the stream has sent: the query calibration_mad_weekly, for closed weeks."""
    g = totals.where("n > 0").groupBy("week_end").agg(F.sum("n").alias("n"), F.expr("round(avg(abs(100d * wins / n - price)), 8)").alias("mean_absolute_deviation"))
    return g.where(F.col("n") >= least)


def run(ticks: DataFrame, target: str, checkpoint: str, late: str = "1 day"):
    """Runs the stream over what is there into Parquet; may be run again and goes on from its state."""
    spark = ticks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = weekly_totals(ticks, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
