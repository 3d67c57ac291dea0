"""A dataset of the latest year, split by event, written behind guards and published whole.

Guards and counts are observed in the passes that write; if one is broken, what was written goes and nothing appears.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.functions.buckets import portable_bucket

SPLITS = ("train", "test", "validation")


@dataclass(frozen=True)
class Layout:
    """The columns that the builder reads: the market's key and event in both tables' names, and the trade's time."""

    ticker: str = "ticker"
    event: str = "event_ticker"
    time: str = "created_time"
    seed: str = "340"


class Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def move(self, to: Folder) -> None:
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"{self.path} can't be moved to {to.path}")

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(self.path, name), False)
        out.write(bytearray(text.encode()))
        out.close()


def split_of(key: Column, seed: str) -> Column:
    b = portable_bucket(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.when(b < 70, "train").when(b < 90, "test").otherwise("validation")


def window_of(trades: DataFrame, time: str) -> tuple:
    """The last time and that of a year before, both inclusive."""
    row = trades.agg(F.max(time).alias("last")).select("last", F.expr("last - INTERVAL 1 YEAR").cast(trades.schema[time].dataType).alias("first")).first()
    if row.last is None:
        raise ValueError("no timestamped trades")
    return row.first, row.last


def build(markets: DataFrame, trades: DataFrame, target: str, layout: Layout = Layout(), form: str = "csv") -> dict:
    """Writes ``target``/trades and ``target``/markets, in folders split=train, test and validation, and manifest.json; gives the manifest.

    Trades of the latest year, both ends included, and the markets that they are of; a market's split is its event's (its
    own where it has none). Either folder read as a whole is the master table, so nothing is stored twice. A market key that is
    null or repeated, trades without a market, no trade at all, and a target that exists are errors, after which there is
    no target; counts that don't add up to those read are one too.
    """
    spark = trades.sparkSession
    place = Folder(spark, target)
    if place.exists():
        raise FileExistsError(target)
    first, last = window_of(trades, layout.time)
    staging = Folder(spark, f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}")
    try:
        manifest = write(markets, trades, str(staging.path), layout, form, first, last)
        staging.write("manifest.json", json.dumps(manifest, indent=2, default=str) + "\n")
        if place.exists():
            raise FileExistsError(target)
        staging.move(place)
    finally:
        staging.delete()
    return manifest


def write(markets: DataFrame, trades: DataFrame, folder: str, layout: Layout, form: str, first, last) -> dict:
    spark, key = trades.sparkSession, layout.ticker
    recent = trades.where(F.col(layout.time).between(F.lit(first), F.lit(last)))
    known = markets.withColumn("split", split_of(F.coalesce(F.col(layout.event).cast("string"), F.col(key).cast("string")), layout.seed))
    seen_trades, seen_markets = Observation(), Observation()
    # trades: the join tells orphans, the same pass counts them and each split's rows
    found = recent.join(known.select(F.col(key).alias("__key"), "split"), F.col(key) == F.col("__key"), "left").drop("__key")
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    found = found.observe(seen_trades, F.count(F.lit(1)).alias("n"), F.count_if(F.col("split").isNull()).alias("orphans"), *counts)
    found.write.partitionBy("split").option("header", True).format(form).save(f"{folder}/trades")
    # markets: all of them are counted by key before those without a trade go
    own = Window.partitionBy(key)
    marked = known.withColumn("__n", F.count(F.lit(1)).over(own)).join(recent.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left")
    marked = marked.observe(seen_markets, F.count_if(F.col("__n") > 1).alias("repeated"), F.count_if(F.col(key).isNull()).alias("unnamed"), F.count_if(F.col("__key").isNotNull()).alias("n"))
    marked.where(F.col("__key").isNotNull()).drop("__n", "__key").write.partitionBy("split").option("header", True).format(form).save(f"{folder}/markets")
    t, m = seen_trades.get, seen_markets.get
    if m["repeated"] or m["unnamed"]:
        raise ValueError(f"{m['repeated']} rows of repeated and {m['unnamed']} of null market keys")
    if t["orphans"]:
        raise ValueError(f"{t['orphans']} recent trades have no market")
    stored = {n: spark.read.option("header", True).format(form).load(f"{folder}/{n}") for n in ("trades", "markets")}
    rows = {r["split"]: r for r in stored["markets"].groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce(F.col(layout.event).cast("string"), F.col(key).cast("string"))).alias("events")).collect()}
    kept = {r["split"]: r["count"] for r in stored["trades"].groupBy("split").count().collect()}
    if sum(kept.values()) != t["n"] or sum(r["n"] for r in rows.values()) != m["n"] or any(kept.get(s, 0) != t[s] for s in SPLITS):
        raise ValueError("rows stored differ from rows read")
    splits = {s: {"markets": rows[s]["n"] if s in rows else 0, "trades": t[s], "events": rows[s]["events"] if s in rows else 0, "trade_fraction": t[s] / t["n"]} for s in SPLITS}
    return {
        "window_start_inclusive": str(first), "window_end_inclusive": str(last), "seed": layout.seed, "grouping_key": f"{layout.event}, else {key}", "method": "first 32 bits of MD5 of seed:key modulo 100; train 0-69, test 70-89, validation 90-99",
        "splits": splits, "master": {"markets": m["n"], "trades": t["n"]}, "completed": True,
    }


def validate(spark: SparkSession, target: str, form: str = "csv", layout: Layout = Layout()) -> dict:
    """The manifest, once the rows stored and the disjointness of the splits' events agree with it."""
    text = spark.read.text(f"{target}/manifest.json", wholetext=True).first()
    manifest = json.loads(text.value)
    for name in ("markets", "trades"):
        df = spark.read.option("header", True).format(form).load(f"{target}/{name}")
        found = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
        if found != {s: v[name] for s, v in manifest["splits"].items() if v[name]} or sum(found.values()) != manifest["master"][name]:
            raise ValueError(f"{name} stored: {found}")
        if name == "markets" and df.groupBy(F.coalesce(F.col(layout.event).cast("string"), F.col(layout.ticker).cast("string"))).agg(F.countDistinct("split").alias("n")).where("n > 1").head(1):
            raise ValueError("an event is in several splits")
    return manifest
