"""Functions, sources, sinks, streaming and text operators."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import buckets as b
from calibra.functions import stats as st
from calibra.operators.positions import cells, dual
from calibra.sources import readers as r
from calibra.sources import sinks as s
from calibra.streaming import ingest as i


def test_distributions():
    assert abs(st.normal_cdf(1.959963985) - 0.975) < 1e-9
    assert abs(st.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(st.t_two_sided(1.0, 1) - 0.5) < 1e-12
    assert abs(st.beta_cdf(2, 3, 0.4) - 0.5248) < 1e-12


def test_golden_fixture(spark):
    rows = [(k * 3 + v, p, *x) for k, p in enumerate([10, 20, 30, 50, 60, 70, 90]) for v, x in enumerate([("A", "yes", 10, "yes"), ("B", "no", 5, "no"), ("B", "yes", 3, "no")]) for _ in range(100)]
    trades = spark.createDataFrame([(100 - p if v % 3 == 1 else p, side, cnt, result) for v, p, _, side, cnt, result in rows], "yes_price int, side string, cnt long, result string")
    won = {x.price: (x.n, x.w) for x in dual(cells(trades)).groupBy("price").agg(F.sum("n").alias("n"), F.expr("sum(n * won)").alias("w")).collect()}
    assert won == {10: (600, 300), 20: (300, 200), 30: (600, 300), 40: (300, 100), 50: (600, 300), 60: (300, 200), 70: (600, 300), 80: (300, 100), 90: (600, 300)}


def test_scalars(spark):
    df = spark.createDataFrame([("0.5700", 10, "ABC-1"), ("x", 100, ""), (None, 1, None)], "d string, p int, e string")
    got = df.select(b.cents(F.col("d")), b.cents(F.col("d"), True), b.decile(F.col("p")), b.decile(F.col("p"), "right"), b.leading_category(F.col("e"))).collect()
    assert [tuple(x) for x in got] == [(56, 57, 10, 0, "ABC"), (None, None, 100, 9, "independent"), (None, None, 0, 0, "independent")]
    assert spark.range(1).select(b.title_case(F.lit("win_rate")), b.short_number(F.lit(2_500_000))).first()[:] == ("Win Rate", "2.5M")


def test_text_csv_and_audit(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("trade_id,ticker,taker_side,yes_price,no_price,count,created_time\n1,A,yes,40,60,3,2024-01-01T00:00:00Z\n2,,no,40,60,3,2024-01-01T00:00:00Z\n3,A,no,40,61,x,2024-01-01T00:00:00Z\n")
    columns = ["trade_id", "ticker", "taker_side", "yes_price", "no_price", "count", "created_time"]
    df = r.typed(r.text_csv(spark, str(p), columns), {"yes_price": "int", "no_price": "int", "count": "int", "created_time": "timestamp"})
    assert [x[0] for x in df.select(r.valid_trade()).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        r.text_csv(spark, str(p), ["nope"])


def test_log_words_and_lookup(spark, tmp_path):
    data = (2**100 + 7).to_bytes(32, "big") + bytes(12) + bytes.fromhex("ab" * 20)
    got = spark.createDataFrame([(bytearray(data),)], "d binary").select(r.word_number("d", 0), r.word_address("d", 1)).first()
    assert int(got[0]) == 2**100 + 7 and got[1] == "0x" + "ab" * 20
    (tmp_path / "l.json").write_text(json.dumps({"0xA": {"collateral_symbol": "USDC"}, "0xB": {"collateral_symbol": "DAI"}}))
    rows = r.json_lookup(spark, str(tmp_path / "l.json"), "collateral_symbol:string").where("collateral_symbol = 'USDC'").collect()
    assert [x.key for x in rows] == ["0xA"]


def test_paging():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise r.TooManyRequests
        return "ok"

    assert r.with_retries(flaky, sleep=lambda _: None) == "ok"
    pages = {"": ([1], "a"), "a": ([2], "")}
    assert [x for rows, _ in r.by_cursor(lambda c: pages[c]) for x in rows] == [1, 2]
    assert [x for rows, _ in r.by_offset(lambda o, n: list(range(5))[o : o + n], 2) for x in rows] == list(range(5))

    def logs(a, z):
        if z - a > 2:
            raise OverflowError
        return list(range(a, z + 1))

    assert r.by_halving(logs, 0, 20) == list(range(21))


def test_block_source(spark):
    spark.dataSource.register(r.block_source("test_blocks", "block long, v long", lambda a, z: [(k, k * k) for k in range(a, z + 1)]))
    df = spark.read.format("test_blocks").options(first=0, last=25, span=10).load()
    assert df.count() == 26 and df.agg(F.sum("v")).first()[0] == sum(k * k for k in range(26))


def test_sinks(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "k")
    s.insert_absent(df, f"{tmp_path}/t", "k")
    s.insert_absent(spark.range(20, 30).withColumnRenamed("id", "k"), f"{tmp_path}/t", "k")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 30
    assert [p.rsplit(".", 1)[-1] for p in s.save(df, str(tmp_path), "x", ["csv", "png", "json"])] == ["csv", "json"]
    assert s.count_rows(spark, f"{tmp_path}/x.csv") == 25
    assert json.loads(s.chart_of(df, "line", "k", ["k"]).to_json()).keys() == {"type", "data", "xKey", "yKeys"}
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("m.csv", "a")
    s.install(str(archive), s.checksum(str(archive)), ["m.csv"], f"{tmp_path}/in")
    assert (tmp_path / "in/m.csv").read_text() == "a"
    with pytest.raises(ValueError):
        s.install(str(archive), "0", ["m.csv"], f"{tmp_path}/no")
    assert not (tmp_path / "no").exists()


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events.limit(50)).repartition(4).write.parquet(f"{tmp_path}/src")
    stream = lambda: i.file_stream(spark, f"{tmp_path}/src", events.schema)
    for _ in range(2):
        i.upsert_absent(stream(), f"{tmp_path}/up", f"{tmp_path}/c1", "event_id")
    assert spark.read.parquet(f"{tmp_path}/up").count() == events.count()
    i.ingest(stream(), f"{tmp_path}/in", f"{tmp_path}/c2", ["event_id"], late="90 days")
    assert spark.read.parquet(f"{tmp_path}/in").count() == events.count()
    got = i.run_to_table(i.cumulative_counts(stream(), "event_type"), "counts", "complete", f"{tmp_path}/c3").collect()
    assert sum(x.n for x in got) == events.count() + 50
    days = i.run_to_table(i.tumbling_counts(stream()), "days", "complete", f"{tmp_path}/c4").collect()
    assert sum(x.n for x in days) == events.count() + 50


def test_inferred_csv(spark, tmp_path):
    from calibra.sources.readers import inferred_csv

    (tmp_path / "x.csv").write_text("a,b,c,d\n1,2.5,yes,2024-01-02\n30,,no,2024-02-03\n")
    got = inferred_csv(spark, str(tmp_path / "x.csv"))
    assert [t for _, t in got.dtypes] == ["int", "double", "string", "date"] and got.count() == 2
