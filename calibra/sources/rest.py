"""REST pulls and chain logs as Spark data sources, batch and streaming.

The offset of a stream is the server's own place: a cursor, a row number, a block. Spark's checkpoint keeps it, so an
interrupted query goes on from its last batch. Requests are paced, tried again where that may help, and timed out.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from calibra.sources.pulls import Paced, checked
from calibra.sources.readers import BlockRange, by_halving, with_retries
from calibra.sources.sinks import insert_absent


class JsonClient:
    """JSON over HTTP: ``per_second`` requests at most, ``attempts`` for busy or broken servers with growing waits, a timeout for each."""

    def __init__(self, url: str, per_second: float = 10.0, attempts: int = 5, timeout: float = 30.0, wait: float = 1.0):
        self.url, self.attempts, self.timeout, self.wait = url.rstrip("/"), attempts, timeout, wait
        self.paced = Paced(self.once, per_second)

    def once(self, request: urllib.request.Request):
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return checked(answer.status, json.load(answer))
        except urllib.error.HTTPError as e:
            return checked(e.code, None)
        except urllib.error.URLError as e:
            raise ConnectionError(str(e.reason)) from e

    def send(self, request: urllib.request.Request):
        return with_retries(lambda: self.paced(request), self.attempts, self.wait)

    def get(self, path: str, **params):
        asked = urllib.parse.urlencode({k: v for k, v in params.items() if v not in (None, "")})
        return self.send(urllib.request.Request(f"{self.url}/{path.lstrip('/')}" + (f"?{asked}" if asked else "")))

    def call(self, method: str, *params):
        """A JSON-RPC call; an answer that is too large for the server is an OverflowError."""
        body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
        answer = self.send(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}))
        if "error" in answer:
            said = str(answer["error"].get("message", answer["error"]))
            raise OverflowError(said) if re.search("(?i)too large|too many|more than|limit|range", said) else ValueError(said)
        return answer["result"]


def client_of(options) -> JsonClient:
    return JsonClient(options["url"], float(options.get("per_second", 10)), int(options.get("attempts", 5)), float(options.get("timeout", 30)), float(options.get("wait", 1)))


def value_of(x, kind):
    """A JSON value as a value of the column's type; null where it doesn't fit."""
    try:
        if x is None:
            return None
        if isinstance(kind, StringType):
            return x if isinstance(x, str) else json.dumps(x)
        if isinstance(kind, (LongType, IntegerType)):
            return int(x)
        if isinstance(kind, DoubleType):
            return float(x)
        if isinstance(kind, BooleanType):
            return x if isinstance(x, bool) else None
        if isinstance(kind, ArrayType):
            return [value_of(y, kind.elementType) for y in x] if isinstance(x, list) else None
    except (ValueError, TypeError, OverflowError):
        return None
    raise ValueError(f"columns of type {kind.simpleString()} can't be pulled; take text and cast it")


class Pages:
    """The pages of a list that a server gives out by cursor or by row number.

    Options: url, path, mode (cursor or offset), rows (the key of the list; none for a bare list), limit; cursor (the key of
    the next cursor, 'cursor'); any option param.x is a parameter x of each request.
    """

    def __init__(self, options, schema: StructType):
        self.options, self.schema = dict(options), schema
        self.mode, self.limit = self.options.get("mode", "cursor"), int(self.options.get("limit", 1000 if self.options.get("mode", "cursor") == "cursor" else 500))
        if self.mode not in ("cursor", "offset"):
            raise ValueError("mode is cursor or offset")
        self.client = None

    def start(self):
        return "" if self.mode == "cursor" else 0

    def page(self, place, limit: int | None = None) -> tuple[list[tuple], object, bool]:
        """(rows, the next place, whether this page is the last for now)."""
        self.client = self.client or client_of(self.options)
        key = self.options.get("cursor", "cursor")
        fixed = {k[6:]: v for k, v in self.options.items() if k.startswith("param.")}
        n = min(limit or self.limit, self.limit)
        answer = self.client.get(self.options["path"], **fixed, limit=n, **({key: place} if self.mode == "cursor" else {"offset": str(place)}))
        found = answer if "rows" not in self.options else answer.get(self.options["rows"]) or []
        rows = [tuple(value_of(x.get(f.name), f.dataType) for f in self.schema) for x in found]
        if self.mode == "cursor":
            following = answer.get(key) or ""
            return rows, following, not following
        return rows, place + len(rows), len(rows) < n

    def through(self, place=None) -> Iterator[tuple]:
        place = self.start() if place is None else place
        last = False
        while not last:
            rows, place, last = self.page(place)
            yield from rows


class PageReader(DataSourceReader):
    """All pages, in one task: the next page's place comes with the page before."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def read(self, partition):
        yield from self.pages.through()


class PageStream(SimpleDataSourceStreamReader):
    """``pages`` pages a batch. The offset is the place of the next page; at the end of a cursor's list it says so, and at the
    end of a list by row number the stream waits there for more."""

    def __init__(self, pages: Pages):
        self.pages, self.most = pages, int(pages.options.get("pages", 1))

    def initialOffset(self) -> dict:
        return {"place": self.pages.start(), "ended": False, "pages": 0}

    def read(self, start: dict):
        rows, place, ended, count = [], start["place"], start["ended"], 0
        while not ended and count < self.most:
            more, place, last = self.pages.page(place)
            rows += more
            count += 1 if more or self.pages.mode == "cursor" else 0
            ended = last and self.pages.mode == "cursor"
            if last:
                break
        return iter(rows), {"place": place, "ended": ended, "pages": start["pages"] + count}

    def readBetweenOffsets(self, start: dict, end: dict):
        """The same pages once more: as many, or up to the same row."""
        place = start["place"]
        if self.pages.mode == "cursor":
            for _ in range(end["pages"] - start["pages"]):
                rows, place, _ = self.pages.page(place)
                yield from rows
        else:
            while place < end["place"]:
                rows, place, _ = self.pages.page(place, end["place"] - place)
                if not rows:
                    raise ValueError(f"the server has lost rows from {place} on")
                yield from rows


class PageSource(DataSource):
    """spark.read or readStream.format("rest_pages").schema(...).option("url", ...).option("path", ...); see Pages for the options."""

    @classmethod
    def name(cls):
        return "rest_pages"

    def reader(self, schema):
        return PageReader(Pages(self.options, schema))

    def simpleStreamReader(self, schema):
        return PageStream(Pages(self.options, schema))


LOG_SCHEMA = "block long, log_index long, transaction string, address string, topic0 string, topics array<string>, data binary"


class Logs:
    """Event logs of a chain by block range. Options: url, span (blocks a partition), address, topic0, lag (blocks that are left for later)."""

    def __init__(self, options):
        self.options = dict(options)
        self.span, self.lag = int(self.options.get("span", 1000)), int(self.options.get("lag", 0))
        self.wanted = {k: [self.options[k].lower()] for k in ("address", "topic0") if k in self.options}

    def head(self) -> int:
        return int(client_of(self.options).call("eth_blockNumber"), 16) - self.lag

    def ranges(self, first: int, last: int) -> list[BlockRange]:
        return [BlockRange(a, min(last, a + self.span - 1)) for a in range(first, last + 1, self.span)]

    def rows(self, part: BlockRange) -> Iterator[tuple]:
        client = client_of(self.options)

        def fetch(a: int, z: int) -> list:
            asked: dict = {"fromBlock": hex(a), "toBlock": hex(z)}
            if "address" in self.wanted:
                asked["address"] = self.wanted["address"]
            if "topic0" in self.wanted:
                asked["topics"] = [self.wanted["topic0"]]
            return client.call("eth_getLogs", asked)

        for x in by_halving(fetch, part.first, part.last):
            topics = [t.lower() for t in x.get("topics", [])]
            yield int(x["blockNumber"], 16), int(x["logIndex"], 16), x.get("transactionHash"), x["address"].lower(), topics[0] if topics else None, topics, bytes.fromhex(x["data"].removeprefix("0x"))


class LogReader(DataSourceReader):
    """Blocks first to last (or the head), a partition for each span. Filters on block, address and topic0 go to the server."""

    def __init__(self, logs: Logs):
        self.logs = logs
        self.first, self.last = int(logs.options.get("first", 0)), logs.options.get("last")

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("address", "topic0"):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                held = self.logs.wanted.get(column)
                self.logs.wanted[column] = [v for v in values if held is None or v in held]
                yield f  # the server may not tell upper from lower case
            elif isinstance(f, GreaterThanOrEqual) and column == "block":
                self.first = max(self.first, f.value)
            elif isinstance(f, LessThanOrEqual) and column == "block":
                self.last = f.value if self.last is None else min(int(self.last), f.value)
            else:
                yield f

    def partitions(self):
        if any(not v for v in self.logs.wanted.values()):
            return []
        return self.logs.ranges(self.first, self.logs.head() if self.last is None else int(self.last))

    def read(self, partition):
        yield from self.logs.rows(partition) if partition else ()


class LogStream(DataSourceStreamReader):
    """The offset is the next block; a batch goes to the head, in partitions that executors read. The head alone tells the end
    of a batch, since a reader that starts again isn't told where the checkpoint stands."""

    def __init__(self, logs: Logs):
        self.logs = logs

    def initialOffset(self) -> dict:
        return {"block": int(self.logs.options.get("first", 0))}

    def latestOffset(self) -> dict:
        return {"block": max(int(self.logs.options.get("first", 0)), self.logs.head() + 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.logs.ranges(start["block"], end["block"] - 1)

    def read(self, partition):
        yield from self.logs.rows(partition)


class LogSource(DataSource):
    """spark.read or readStream.format("chain_logs").option("url", ...).option("first", ...); see Logs for the options."""

    @classmethod
    def name(cls):
        return "chain_logs"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema):
        return LogReader(Logs(self.options))

    def streamReader(self, schema):
        return LogStream(Logs(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets their readers see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PageSource, LogSource):
        spark.dataSource.register(source)


def backfill(stream: DataFrame, target: str, checkpoint: str, key: str | None = None):
    """Runs a pull into Parquet until nothing new comes. It may be interrupted and run again: it goes on from the checkpoint.

    The file sink takes whole batches, so none is lost or doubled. With ``key``, a row that the server gives twice is stored once.
    """
    if key:
        writer = stream.writeStream.foreachBatch(lambda df, _: insert_absent(df, target, key))
    else:
        writer = stream.writeStream.format("parquet").option("path", target)
    query = writer.option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
