"""Typed sources: text CSV with safe casts, JSON lookups, event logs of 32-byte words, and paged REST pulls."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a head, every column text; empty fields stay empty strings. Missing columns are an error."""
    found = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in found]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    schema = StructType([StructField(c, StringType()) for c in found])
    return spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\0").schema(schema).csv(path).select(*columns)


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a head, types found from all its values: whole and broken numbers, dates, times, truth values, else text."""
    return spark.read.option("header", True).option("inferSchema", True).option("preferDate", True).csv(path)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to ``types``; what doesn't parse is null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def valid_trade() -> Column:
    """A well-formed trade: ids there, a known side, prices within 1-99 that add up to 100, a positive count. Never null."""
    sound = (F.trim("trade_id") != "") & (F.trim("ticker") != "") & F.col("taker_side").isin("yes", "no") & F.col("yes_price").between(1, 99) & F.col("no_price").between(1, 99) & (F.col("yes_price") + F.col("no_price") == 100) & (F.col("count") > 0) & F.col("created_time").isNotNull()
    return F.coalesce(sound, F.lit(False))


def json_lookup(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON object of objects as rows (key, fields...)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{fields}>>").alias("m"))
    return raw.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def word(data: str, k: int) -> Column:
    """The k-th 32-byte big-endian word of a binary log, as hexadecimal text."""
    return F.hex(F.substring(data, 32 * k + 1, 32))


def word_number(data: str, k: int) -> Column:
    """Word k as a decimal; null beyond 38 digits. Parts of 2, 15 and 15 hexadecimal digits are exact in a long."""
    text = word(data, k)
    part = lambda at, n: F.conv(F.substring(text, at, n), 16, 10).cast("decimal(20,0)")
    low = (part(35, 15) * F.lit(16**15).cast("decimal(20,0)") + part(50, 15)).cast("decimal(38,0)")
    top = F.try_multiply(part(33, 2).cast("decimal(3,0)"), F.lit(str(16**30)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.when(F.substring(text, 1, 32) == "0" * 32, F.try_add(top, low).cast("decimal(38,0)"))


def word_address(data: str, k: int) -> Column:
    """Word k as an address: its last 20 bytes."""
    return F.concat(F.lit("0x"), F.lower(F.substring(word(data, k), 25, 40)))


class TooManyRequests(Exception):
    """The server asks to slow down."""


def with_retries(call: Callable, attempts: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after TooManyRequests or a broken connection, waiting exponentially longer with jitter."""
    for k in range(attempts):
        try:
            return call()
        except (TooManyRequests, ConnectionError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(base * 2**k * (1 + random.random()))


def by_cursor(fetch: Callable[[str], tuple[list, str]], cursor: str = "") -> Iterator[tuple[list, str]]:
    """Pages (rows, next cursor) until the cursor is empty."""
    while True:
        rows, cursor = with_retries(lambda at=cursor: fetch(at))
        yield rows, cursor
        if not cursor:
            return


def by_offset(fetch: Callable[[int, int], list], limit: int = 500, offset: int = 0) -> Iterator[tuple[list, int]]:
    """Pages (rows, next offset) until one is short."""
    while True:
        rows = with_retries(lambda at=offset: fetch(at, limit))
        offset += len(rows)
        yield rows, offset
        if len(rows) < limit:
            return


def by_halving(fetch: Callable[[int, int], list], first: int, last: int, too_large: type[Exception] = OverflowError) -> list:
    """Logs of blocks first..last; a range that the server finds too large is halved."""
    try:
        return with_retries(lambda: fetch(first, last))
    except too_large:
        if first == last:
            raise
        middle = (first + last) // 2
        return by_halving(fetch, first, middle, too_large) + by_halving(fetch, middle + 1, last, too_large)


class BlockRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def block_source(name: str, schema: str, fetch: Callable[[int, int], list]) -> type[DataSource]:
    """A data source class that reads blocks ``first`` to ``last`` in ranges of ``span``, a partition each, by ``fetch``."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.first, self.last, self.span = int(options["first"]), int(options["last"]), int(options.get("span", 1000))

        def partitions(self):
            return [BlockRange(a, min(self.last, a + self.span - 1)) for a in range(self.first, self.last + 1, self.span)]

        def read(self, partition):
            yield from map(tuple, by_halving(fetch, partition.first, partition.last))

    return Source
