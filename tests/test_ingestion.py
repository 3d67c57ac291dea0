"""REST and chain-log data sources against a local server; the dataset builder and its guards."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from calibra.sources import dataset, rest
from calibra.sources.pulls import RequestFailed

SCHEMA = "trade_id string, count long, price double, live boolean, tags array<string>"


class Server:
    """Lists by cursor and by row number, and a chain; every ``busy``-th request is refused, ``down`` ones break."""

    def __init__(self):
        self.rows = [{"trade_id": f"t{k}", "count": str(k), "price": k / 4, "live": k % 2 == 0, "tags": ["a", 1], "more": 1} for k in range(53)]
        self.logs = [{"blockNumber": hex(k), "logIndex": hex(k % 3), "transactionHash": f"0x{k:02x}", "address": "0xAB" if k % 2 else "0xcd", "topics": [f"0xT{k % 4}", "0x01"], "data": "0x" + f"{k:064x}"} for k in range(200)]
        self.head, self.asked, self.busy, self.stop_at, self.largest = 149, [], 4, None, 20
        server = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def answer(self, status, body):
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def refused(self, what):
                server.asked.append(what)
                if server.busy and len(server.asked) % server.busy == 0:
                    self.answer(429, {})
                    return True
                return False

            def do_GET(self):
                url = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                if self.refused((url.path, q)):
                    return
                if url.path == "/gone":
                    return self.answer(404, {})
                at, n = int(q.get("cursor") or q.get("offset") or 0), int(q["limit"])
                if server.stop_at is not None and at >= server.stop_at:
                    return self.answer(400, {})
                page = server.rows[at : at + n]
                if url.path == "/cursor":
                    return self.answer(200, {"trades": page, "cursor": str(at + n) if at + n < len(server.rows) else ""})
                self.answer(200, page)

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                if self.refused((body["method"], body["params"])):
                    return
                if body["method"] == "eth_blockNumber":
                    return self.answer(200, {"result": hex(server.head)})
                p = body["params"][0]
                a, z = int(p["fromBlock"], 16), int(p["toBlock"], 16)
                if z - a >= server.largest:
                    return self.answer(200, {"error": {"code": -32005, "message": "query returned more than 20 results"}})
                low = [x.lower() for x in p.get("address", [])]
                tops = [x.lower() for x in (p.get("topics") or [[]])[0]]
                found = [x for x in server.logs if a <= int(x["blockNumber"], 16) <= z and int(x["blockNumber"], 16) <= server.head and (not low or x["address"].lower() in low) and (not tops or x["topics"][0].lower() in tops)]
                self.answer(200, {"result": found})

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


@pytest.fixture(scope="module")
def sources(spark):
    rest.register(spark)
    return spark


def options(server, **more):
    return {"url": server.url, "per_second": 500, "wait": 0.001, **more}


def test_client(server):
    client = rest.JsonClient(server.url, 1000, wait=0.001)
    server.busy = 2
    client.get("offset", limit=1)
    assert len(client.get("offset", limit=2, offset=51)) == 2
    with pytest.raises(RequestFailed):
        client.get("gone", limit=1)
    server.busy = 1
    with pytest.raises(Exception, match="429"):
        rest.JsonClient(server.url, 1000, attempts=2, wait=0.001).get("offset", limit=1)
    with pytest.raises(ConnectionError):
        rest.JsonClient("http://127.0.0.1:1", attempts=1).get("x")


@pytest.mark.parametrize("mode,extra", [("cursor", {"rows": "trades"}), ("offset", {})])
def test_batch_pull(sources, server, mode, extra):
    df = sources.read.format("rest_pages").schema(SCHEMA).options(**options(server, path=mode, mode=mode, limit=10, **extra, **{"param.status": "open"})).load()
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    assert got == [(f"t{k}", k, k / 4, k % 2 == 0, ["a", "1"]) for k in range(53)]
    assert all(q[1].get("status") == "open" for q in server.asked)


@pytest.mark.parametrize("mode,extra", [("cursor", {"rows": "trades"}), ("offset", {})])
def test_interrupted_pull_goes_on(sources, server, tmp_path, mode, extra):
    def run():
        df = sources.readStream.format("rest_pages").schema(SCHEMA).options(**options(server, path=mode, mode=mode, limit=7, pages=2, **extra)).load()
        rest.backfill(df, f"{tmp_path}/out", f"{tmp_path}/place")

    server.stop_at = 30  # the server refuses what lies beyond
    with pytest.raises(Exception):
        run()
    part = sources.read.parquet(f"{tmp_path}/out").count()
    assert 0 < part < 53
    server.stop_at, before = None, len(server.asked)
    run()
    got = sorted(r.n for r in sources.read.parquet(f"{tmp_path}/out").selectExpr("`count` AS n").collect())
    assert got == list(range(53))
    again = [q for _, q in server.asked[before:]]
    assert all(int(q.get("cursor") or q.get("offset") or 0) >= 14 for q in again)  # pages that were stored aren't asked for again
    server.rows += [{"trade_id": "new", "count": 53, "price": 1, "live": True, "tags": []}]
    run()
    assert sources.read.parquet(f"{tmp_path}/out").count() == (54 if mode == "offset" else 53)


def test_pull_with_key_stores_once(sources, server, tmp_path):
    server.rows += server.rows[:5]
    df = sources.readStream.format("rest_pages").schema(SCHEMA).options(**options(server, path="offset", mode="offset", limit=20)).load()
    rest.backfill(df, f"{tmp_path}/out", f"{tmp_path}/place", key="trade_id")
    assert sources.read.parquet(f"{tmp_path}/out").count() == 53


def test_logs(sources, server):
    df = sources.read.format("chain_logs").options(**options(server, first=5, last=120, span=50)).load()
    got = sorted(tuple(r) for r in df.select("block", "log_index", "address", "topic0", "topics", "data").collect())
    assert got == [(k, k % 3, "0xab" if k % 2 else "0xcd", f"0xt{k % 4}", [f"0xt{k % 4}", "0x01"], k.to_bytes(32, "big")) for k in range(5, 121)]


def test_filters_reach_the_server(sources, server):
    server.largest = 1000
    df = sources.read.format("chain_logs").options(**options(server, first=0, last=199, span=60)).load()
    got = df.where("topic0 = '0xt3' AND address = '0xab' AND block >= 100 AND block <= 130").collect()
    assert sorted(r.block for r in got) == [k for k in range(100, 131) if k % 4 == 3]
    asked = [p[0] for m, p in server.asked if m == "eth_getLogs"]
    assert all(p["topics"] == [["0xt3"]] and p["address"] == ["0xab"] for p in asked)
    assert min(int(p["fromBlock"], 16) for p in asked) == 100 and max(int(p["toBlock"], 16) for p in asked) == 130


def test_log_stream_follows_the_head(sources, server, tmp_path):
    def run():
        df = sources.readStream.format("chain_logs").options(**options(server, first=10, span=40)).load()
        rest.backfill(df, f"{tmp_path}/out", f"{tmp_path}/place")
        return sorted(r.block for r in sources.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(10, 150))
    assert run() == list(range(10, 150))
    server.head = 180
    assert run() == list(range(10, 181))


@pytest.fixture
def market_tables(spark):
    markets = spark.createDataFrame([(f"M{k}", f"E{k // 2}" if k % 5 else None, "x, \"y\"") for k in range(60)], "ticker string, event_ticker string, title string")
    trades = spark.range(4000).selectExpr("id AS trade_id", "concat('M', id % 50) AS ticker", "timestamp'2023-06-01' + make_dt_interval(cast(id / 5 AS int)) AS created_time", "id % 7 AS `count`")
    return markets, trades


def read(spark, path):
    return spark.read.option("header", True).csv(path)


def test_dataset(spark, tmp_path, market_tables):
    markets, trades = market_tables
    made = dataset.build(markets, trades, f"{tmp_path}/d")
    assert dataset.validate(spark, f"{tmp_path}/d") == json.loads((tmp_path / "d/manifest.json").read_text()) == json.loads(json.dumps(made))
    last = trades.agg(F.max("created_time")).first()[0]
    recent = [r for r in trades.collect() if r.created_time >= last.replace(year=last.year - 1)]
    assert made["master"] == {"markets": 50, "trades": len(recent)} and len(recent) < 4000
    t, m = read(spark, f"{tmp_path}/d/trades"), read(spark, f"{tmp_path}/d/markets")
    assert sorted(int(r.trade_id) for r in t.collect()) == sorted(r.trade_id for r in recent)
    split = {r.ticker: r.split for r in m.collect()}
    assert all(split[r.ticker] == r.split for r in t.collect()) and {r.title for r in m.collect()} == {'x, "y"'}
    events = {r.event_ticker or r.ticker: r.split for r in m.collect()}
    assert all(events[r.event_ticker or r.ticker] == r.split for r in m.collect())
    assert sum(s["trade_fraction"] for s in made["splits"].values()) == pytest.approx(1) and sum(s["events"] for s in made["splits"].values()) == len(events)
    with pytest.raises(FileExistsError):
        dataset.build(markets, trades, f"{tmp_path}/d")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d"]
    (tmp_path / "d/trades/split=train").rename(tmp_path / "d/trades/split=test2")
    with pytest.raises(ValueError, match="stored"):
        dataset.validate(spark, f"{tmp_path}/d")


def test_broken_inputs_leave_nothing(spark, tmp_path, market_tables):
    markets, trades = market_tables
    broken = {
        "repeated": (markets.union(markets.limit(1)), trades),
        "null": (markets.union(spark.createDataFrame([(None, "E", "t")], markets.schema)), trades),
        "no market": (markets.where("ticker <> 'M7'"), trades),
        "no timestamped": (markets, trades.where("false")),
        "timestamped": (markets, trades.withColumn("created_time", F.lit(None).cast("timestamp"))),
    }
    for message, (m, t) in broken.items():
        with pytest.raises(ValueError, match=message):
            dataset.build(m, t, f"{tmp_path}/d")
        assert not list(tmp_path.iterdir()), message
    old = trades.withColumn("ticker", F.when(F.col("created_time") < "2024-01-01", "gone").otherwise(F.col("ticker")))
    dataset.build(markets, old, f"{tmp_path}/d")  # an orphan before the window is no fault
