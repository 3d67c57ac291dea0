"""The dataset of the latest year, built and counted."""

from __future__ import annotations

import uuid

from calibra.operators.stage import shared_dir
from calibra.plans.base import query
from calibra.sources import adapter
from calibra.sources.dataset import Layout, build

_LAYOUT = Layout("ticker", "event_id", "traded_on", "340")


@query("dataset_manifest", """, w AS (SELECT CAST(max(traded_on) - INTERVAL 1 YEAR AS DATE) AS a, max(traded_on) AS z FROM trades), t AS (SELECT ticker FROM trades, w WHERE traded_on BETWEEN a AND z),
s AS (SELECT ticker, coalesce(event_id, ticker) AS event, CAST('0x' || substr(md5('340:' || coalesce(event_id, ticker)), 1, 8) AS BIGINT) % 100 AS b FROM markets WHERE ticker IN (SELECT ticker FROM t)),
n AS (SELECT *, CASE WHEN b < 70 THEN 'train' WHEN b < 90 THEN 'test' ELSE 'validation' END AS split FROM s),
c AS (SELECT n.split, count(*) AS trades FROM t JOIN n USING (ticker) GROUP BY n.split)
SELECT n.split, count(*) AS markets, any_value(c.trades) AS trades, count(DISTINCT n.event) AS events, any_value(c.trades) / CAST((SELECT count(*) FROM t) AS DOUBLE) AS trade_fraction FROM n JOIN c ON c.split = n.split GROUP BY n.split""")
def dataset_manifest(spark, sf_dir):
    """Writes the latest year's trades and markets by split into the shared folder; the rows are its manifest's."""
    target = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    made = build(adapter.markets(spark, sf_dir), adapter.trades(spark, sf_dir), target, _LAYOUT, "parquet")
    rows = [(s, v["markets"], v["trades"], v["events"], v["trade_fraction"]) for s, v in made["splits"].items()]
    return spark.createDataFrame(rows, "split string, markets long, trades long, events long, trade_fraction double")
