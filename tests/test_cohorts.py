"""Guards, the event bootstrap, and analyses of a user's own."""

import pytest

from calibra.analysis import discover
from calibra.operators.guards import guarded, integrity, require
from calibra.operators.positions import positions
from calibra.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_require(spark):
    good = spark.createDataFrame([(1, "a", "train"), (2, "a", "train"), (3, "b", "test")], "k int, g string, p string")
    require(good, "k", "g", "p")
    with pytest.raises(ValueError, match="repeated"):
        require(good.union(good.limit(1)), "k")
    with pytest.raises(ValueError, match="several"):
        require(good.union(spark.createDataFrame([(4, "a", "test")], good.schema)), "k", "g", "p")
    with pytest.raises(ValueError, match="no rows"):
        require(good.where("false"), "k", "g", "p")
    assert tuple(integrity(good.where("false"), "k", "g", "p").first()) == (0, 0, 0)


def test_guarded_values_fail_when_read(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, False), (2, None)], "v int, broken boolean")
    assert [r.v for r in df.select(guarded(F.col("v"), F.col("broken"), "odd").alias("v")).collect()] == [1, 2]
    with pytest.raises(Exception, match="odd"):
        df.select(guarded(F.col("v"), F.col("v") == 2, "odd").alias("v")).collect()


def test_event_bootstrap(spark):
    row = QUERIES["event_bootstrap"](spark, SF).first()
    again = QUERIES["event_bootstrap"](spark.newSession(), SF).first()
    p = positions(spark, SF, "event_id").selectExpr("sum(contracts * (pow(won - price / 100d, 2) - pow(won - 0.5d, 2))) / sum(contracts) AS d").first()
    assert row.low < p.d < row.high and abs(row.mean - p.d) < 0.2 * (row.high - row.low) and row.repetitions == 2000
    assert abs(row.low - again.low) < 1e-9


def test_bootstrap_error_is_the_analytic_one(spark):
    """The width agrees with the delta method's error over events."""
    e = positions(spark, SF, "event_id").groupBy("event_id").agg({"contracts": "sum"}).count()
    rows = positions(spark, SF, "event_id").selectExpr("event_id", "contracts * (pow(won - price / 100d, 2) - pow(won - 0.5d, 2)) AS x", "contracts AS w").groupBy("event_id").sum("x", "w").collect()
    total, w = sum(r[1] for r in rows), sum(r[2] for r in rows)
    se = sum((r[1] - r[2] * total / w) ** 2 for r in rows) ** 0.5 / w
    row = QUERIES["event_bootstrap"](spark, SF).first()
    assert len(rows) == e and abs((row.high - row.low) / (2 * 1.96 * se) - 1) < 0.1


def test_tail_parts_recombine(spark):
    r = {x.scope: x for x in QUERIES["brier_top_markets"](spark, SF).collect()}
    assert r["top"].w + r["rest"].w == r["all"].w
    assert abs(r["top"].w * r["top"].brier + r["rest"].w * r["rest"].brier - r["all"].w * r["all"].brier) < 1e-6 * r["all"].w


def test_analyses_of_a_folder(spark, tmp_path):
    (tmp_path / "own.py").write_text(
        "from calibra.analysis import Analysis\n"
        "class Ten(Analysis):\n    name = 'ten'\n    def run(self):\n        return self.spark.range(10)\n"
        "class Base(Analysis):\n    name = 'base'\n"
    )
    (tmp_path / "_left_out.py").write_text("raise RuntimeError\n")
    kinds = discover(str(tmp_path))
    assert list(kinds) == ["ten"]
    path = kinds["ten"](spark, SF).save(str(tmp_path / "out"))
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(Exception, match="(?i)exist"):
        kinds["ten"](spark, SF).save(str(tmp_path / "out"))
    (tmp_path / "twin.py").write_text((tmp_path / "own.py").read_text())
    with pytest.raises(ValueError, match="name"):
        discover(str(tmp_path))
