"""The chunked store, whole event logs, and calibration as stream state."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.plans.time import calibration_mad_weekly
from calibra.sources import chunks, events
from calibra.streaming import calibration

SF = "/root/testdata/sf0.001"


def rows(spark, a, z):
    return spark.range(a, z).selectExpr("format_string('k%06d', id) AS trade_id", "id AS v")


def names(tmp_path):
    return sorted((p.name for p in tmp_path.glob("t_*")), key=lambda n: int(n.split("_")[1]))


def test_chunks_are_topped_up(spark, tmp_path):
    store = chunks.ChunkStore(spark, str(tmp_path), "t", "trade_id", rows=100)
    assert store.append(rows(spark, 0, 250)) == 250
    assert names(tmp_path) == ["t_0_100.parquet", "t_100_200.parquet", "t_200_250.parquet"]
    assert store.append(rows(spark, 240, 420).union(rows(spark, 400, 410))) == 170
    assert [(c.start, c.end) for c in store.chunks()] == [(0, 100), (100, 200), (200, 300), (300, 400), (400, 420)]
    got = sorted(r.v for r in store.read().collect())
    assert got == list(range(420)) and store.read().columns == ["trade_id", "v"]
    assert store.append(rows(spark, 0, 420)) == 0 and len(store.commits()) == 2
    assert store.vacuum() == 2 and names(tmp_path)[2] == "t_200_300.parquet" and store.read().count() == 420
    one = [r.v for r in spark.read.parquet(f"{tmp_path}/t_300_400.parquet").collect()]
    assert one == list(range(300, 400))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(None, 1)], "trade_id string, v long"))


def test_appends_read_few_chunks(spark, tmp_path):
    store = chunks.ChunkStore(spark, str(tmp_path), "t", "trade_id", rows=50)
    store.append(rows(spark, 0, 2000))
    ask = lambda df: [c.start for c in store.candidates(store.chunks(), df.select(F.col("trade_id").alias("key"), F.xxhash64("trade_id").alias("h")))]
    assert ask(rows(spark, 5000, 5100)) == []
    assert ask(rows(spark, 120, 130)) == [100] and set(ask(rows(spark, 95, 106))) == {50, 100}
    odd = rows(spark, 0, 2000).where("v % 50 = 7").withColumn("trade_id", F.concat("trade_id", F.lit("x")))
    assert len(ask(odd)) <= 2  # in the range of all forty chunks, in the filter of hardly any
    assert store.append(odd.union(rows(spark, 0, 60))) == 40


def test_filters():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    stored = chunks.filter_of(h[:1000])
    assert all(chunks.may_hold(stored, h[k : k + 1], 1000) for k in range(1000))
    assert sum(chunks.may_hold(stored, h[k : k + 1], 1000) for k in range(1000, 3000)) <= 3


def test_broken_append_leaves_the_table_as_it_was(spark, tmp_path):
    store = chunks.ChunkStore(spark, str(tmp_path), "t", "trade_id", rows=100)
    store.append(rows(spark, 0, 150))
    broken = rows(spark, 150, 400).withColumn("v", F.when(F.col("v") == 333, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="boom"):
        store.append(broken)
    assert store.read().count() == 150 and len(store.commits()) == 1 and not list((tmp_path / "_staging").iterdir())
    first, second = (chunks.ChunkStore(spark, str(tmp_path), "t", "trade_id", rows=100) for _ in range(2))
    kept = second.commits, second.chunks
    state = (second.commits(), second.chunks())
    second.commits, second.chunks = (lambda: state[0]), (lambda: state[1])
    assert first.append(rows(spark, 150, 160)) == 10
    with pytest.raises(Exception, match="(?i)exist"):
        second.append(rows(spark, 160, 170))
    second.commits, second.chunks = kept
    assert second.append(rows(spark, 160, 170)) == 10 and store.read().count() == 170
    assert json.loads((tmp_path / "_log/000000000001.json").read_text())["number"] == 1


def test_stream_into_chunks(spark, tmp_path):
    from calibra.streaming.ingest import upsert_chunks

    for k in range(3):
        rows(spark, 100 * k, 100 * k + 150).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("trade_id string, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        upsert_chunks(stream, f"{tmp_path}/out", "t", f"{tmp_path}/state", "trade_id", 100)
    store = chunks.ChunkStore(spark, f"{tmp_path}/out", "t", "trade_id", 100)
    assert sorted(r.v for r in store.read().collect()) == list(range(350)) and [c.end for c in store.chunks()] == [100, 200, 300, 350]


def test_whole_events(spark):
    w = lambda x: (x % 2**256).to_bytes(32, "big")
    topic, huge = events.ORDER_FILLED.topic0, 2**255 + 12345
    maker, taker = "0x" + "ab" * 20, "0x" + "00" * 19 + "01"
    t = lambda *xs: [x if isinstance(x, str) else "0x" + x.hex() for x in xs]
    good = (1, t(topic.upper().replace("0X", "0x"), w(7), w(int(maker, 16)), w(1)), w(huge) + w(0) + w(10**38 - 1) + w(5) + w(2**200))
    short, few, odd = (2, good[1], good[2][:-1]), (3, good[1][:3], good[2]), (4, [*good[1][:3], "0xzz"], good[2])
    other, none, wide = (5, t("0x" + "11" * 32), b""), (6, None, None), (7, t(topic, w(7), w(2**180), w(1)), good[2])
    df = spark.createDataFrame([good, short, few, odd, other, none, wide], "id long, topics array<string>, data binary")
    got = {r.id: r for r in events.decode(df, events.ORDER_FILLED).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    r = got[1]
    assert (r.order_hash, r.maker, r.taker, r.maker_asset_id, r.taker_asset_id) == ("0x" + w(7).hex(), maker, taker, str(huge), "0")
    assert int(r.maker_amount) == 10**38 - 1 and int(r.taker_amount) == 5 and r.fee is None
    assert all(got[k][f.name] is None for k in (2, 3, 4) for f in events.ORDER_FILLED.fields)
    assert got[7].maker is None and got[7].taker == taker
    buy = spark.createDataFrame([(t("0x01", w(int(maker, 16)), w(1)), w(100) + w(2) + w(300))], "topics array<string>, data binary")
    r = events.decode(buy, events.FPMM_BUY).first()
    assert (r.trader, int(r.amount), int(r.fee_amount), int(r.outcome_index), int(r.outcome_tokens)) == (maker, 100, 2, 1, 300)
    own = events.Layout("own", None, (events.Field("x", "int256"), events.Field("b", "bool", True), events.Field("c", "bool")))
    r = events.decode(spark.createDataFrame([(t("0x01", w(1)), w(-(10**50)) + w(2))], "topics array<string>, data binary"), own).first()
    assert (r.x, r.b, r.c) == (str(-(10**50)), True, None)


def test_calibration_stream_equals_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{SF}/events.parquet").selectExpr("ts", "cast(1 + floor(value) % 99 AS int) AS price", "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS won")
    days = ticks.selectExpr("min(cast(ts AS date)) AS a", "date_add(max(cast(ts AS date)), 1) AS z").first()
    span = (days.z - days.a).days
    stream = lambda: spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    parts = 3
    for k in range(parts):  # in order of time, a file a part; the stream stops and starts again between them
        low, high = (F.date_add(F.lit(days.a), span * j // parts) for j in (k, k + 1))
        ticks.where((F.to_date("ts") >= low) & (F.to_date("ts") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        calibration.run(stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    calibration.run(stream(), f"{tmp_path}/out", f"{tmp_path}/state")  # nothing new: a run starts from the watermark that the one before left
    got = {r.week_end: (r.n, r.mean_absolute_deviation) for r in calibration.deviation(spark.read.parquet(f"{tmp_path}/out"), least=1).collect()}
    whole = {r.week_end: (r.n, r.mean_absolute_deviation) for r in calibration_mad_weekly(spark, SF, least=1).collect()}
    closed = {w for w in whole if w < max(whole)}
    assert closed and closed <= set(got) and all(got[w] == whole[w] for w in closed)
