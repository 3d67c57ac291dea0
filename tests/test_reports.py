"""P-values against published tables, the chart contract, formats of analyses, and the rule table."""

import json
import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from calibra import analysis
from calibra.functions import stats
from calibra.operators.rules import Automaton, RuleTable
from calibra.plans.market import pruned_tree
from calibra.sources import sinks

SF = "/root/testdata/sf0.001"
#: Published critical values: t, degrees of freedom, two-sided p.
T_TABLE = [(12.706, 1, 0.05), (63.657, 1, 0.01), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.812, 10, 0.1), (2.042, 30, 0.05), (2.750, 30, 0.01), (1.980, 120, 0.05), (2.617, 120, 0.01), (1.960, 10**7, 0.05)]


def test_student_against_the_table():
    for t, df, p in T_TABLE:
        assert abs(stats.t_two_sided(t, df) - p) < 3e-4 * max(1, p / 0.05)
    assert abs(stats.t_two_sided(1.0, 1) - 0.5) < 1e-12 and abs(stats.t_two_sided(math.sqrt(2), 2) - (1 - math.sqrt(0.5))) < 1e-12


def test_sql_twins_of_p_values():
    db = duckdb.connect()
    z = [0.0, 0.1, -0.6745, 1.0, 1.96, -2.5758, 4.0, 8.0, -15.0, 25.0, -25.0]
    for x in z:
        two, up = db.execute(f"SELECT {stats.normal_sql('z')}, {stats.normal_sql('z', upper=True)} FROM (SELECT CAST({x} AS DOUBLE) AS z)").fetchone()
        assert abs(two - 2 * (1 - statistics.NormalDist().cdf(abs(x)))) < 1e-8 and abs(up - (1 - statistics.NormalDist().cdf(x))) < 1e-8
    for t, df, p in [*T_TABLE, (0.3, 7, None), (2.2, 31_415.9, None), (-3.3, 250_000.0, None)]:
        if abs(t) <= 20 and df >= 5:
            got = db.execute(f"SELECT {stats.student_sql('t', 'df')} FROM (SELECT CAST({t} AS DOUBLE) AS t, CAST({df} AS DOUBLE) AS df)").fetchone()[0]
            assert abs(got - stats.t_two_sided(t, df)) < 1e-6


def test_charts():
    points = [{"x": 1, "y": 2.5}]
    assert sinks.line_chart(points, y_unit="dollars", x_scale="log").to_dict() == {"type": "line", "data": points, "xKey": "x", "yKeys": ["y"], "xScale": "log", "yUnit": "dollars"}
    assert sinks.bar_chart(points, y=["y", "z"], stacked=True, colors={"y": "#fff"}).to_dict() == {"type": "stacked-bar", "data": points, "xKey": "x", "yKeys": ["y", "z"], "colors": {"y": "#fff"}}
    assert sinks.area_chart(points, stacked=True).to_dict()["stacked"] is True and sinks.area_chart(points).to_dict()["stacked"] is False
    assert sinks.pie_chart(points, "a", "b").to_dict() == {"type": "pie", "data": points, "nameKey": "a", "valueKey": "b"}
    assert sinks.scatter_chart([], z="n", series={"s": points}).to_dict() == {"type": "scatter", "data": [], "series": [{"name": "s", "data": points}], "xKey": "x", "yKeys": ["y"], "zKey": "n"}
    assert sinks.heatmap(points).to_dict() == {"type": "heatmap", "data": points, "xKey": "x", "yKey": "y", "valueKey": "value"}
    assert sinks.treemap(points).to_dict() == {"type": "treemap", "data": points, "nameKey": "name", "valueKey": "value", "childrenKey": "children"}
    full = sinks.Chart("line", [], **{f: ([] if f in ("y", "dashes") else {} if f in ("series", "colors") else "linear" if f.endswith("scale") else "cents" if f == "y_unit" else 1) for f in sinks.CHART_FIELDS if f not in ("type", "data")})
    assert set(json.loads(full.to_json())) == set(sinks.CHART_FIELDS.values()) and len(sinks.CHART_FIELDS) == 21
    for broken in ({"type": "donut"}, {"type": "line", "y_unit": "yen"}, {"type": "line", "y_scale": "cubic"}):
        with pytest.raises(ValueError):
            sinks.Chart(data=[], **broken)


def test_analyses_save_formats(spark, tmp_path, capsys):
    (tmp_path / "own.py").write_text(
        "from calibra.analysis import Analysis, Indexer, Output\nfrom calibra.sources import sinks\n"
        "class Ten(Analysis):\n    name = 'ten'\n    def run(self):\n        df = self.spark.range(10).withColumnRenamed('id', 'x').selectExpr('x', 'x * x AS y')\n        return Output(df, sinks.line_chart(df))\n"
        "class Bare(Analysis):\n    name = 'bare'\n    def run(self):\n        return self.spark.range(3)\n"
        "class Pull(Indexer):\n    name = 'pull'\n    def run(self):\n        self.spark.range(7).write.parquet(OUT)\n".replace("OUT", repr(f"{tmp_path}/pulled"))
    )
    kinds = analysis.discover(str(tmp_path))
    assert set(kinds) == {"ten", "bare"}
    saved = kinds["ten"](spark, SF).save(str(tmp_path / "out"), ["png", "csv", "json", "parquet", "csv"])
    assert list(saved) == ["csv", "json", "parquet"]
    assert spark.read.option("header", True).csv(saved["csv"]).count() == 10 and spark.read.parquet(saved["parquet"]).count() == 10
    assert json.loads((tmp_path / "out/ten.json").read_text())["data"][3] == {"x": 3, "y": 9}
    assert list(kinds["bare"](spark, SF).save(str(tmp_path / "out"), ["json", "csv.gz"])) == ["csv.gz"]
    analysis.main("index", str(tmp_path), "pull", spark=spark)
    assert spark.read.parquet(f"{tmp_path}/pulled").count() == 7
    analysis.main("analyze", str(tmp_path), SF, str(tmp_path / "more"), "--formats", "json", "ten", spark=spark)
    assert "ten.json" in capsys.readouterr().out and (tmp_path / "more/ten.json").exists()
    for bad in (("analyze", str(tmp_path), SF, "x", "none"), ("draw",), ()):
        with pytest.raises(SystemExit):
            analysis.main(*bad, spark=spark)


def test_automaton_equals_a_loop():
    rng = random.Random(2)
    words = lambda n: ["".join(rng.choices("AB", k=rng.randint(1, 6))) for _ in range(n)]
    for _ in range(30):
        patterns = words(rng.randint(1, 40))
        a = Automaton(patterns)
        for t in ["", *words(60)]:
            assert a.first(t) == next((k for k, p in enumerate(patterns) if p in t), -1)
    assert Automaton(["X", ""]).first("abc") == 1 and Automaton([]).first("abc") == -1


def test_five_hundred_rules(spark):
    rng = random.Random(5)
    rules = [("".join(rng.choices("NFLBTCQ", k=rng.randint(2, 4))).lower(), f"g{k % 7}", f"m{k % 31}", f"s{k}") for k in range(520)]
    texts = ["".join(rng.choices("nFlBtCQz", k=rng.randint(0, 9))) for _ in range(400)] + [None, "", "zzz"]
    df = spark.createDataFrame([(t, "old") for t in texts], "category string, grp string")
    got = RuleTable(rules, ("grp", "mid", "sub")).classify(df, "category")
    assert got.columns == ["category", "grp", "mid", "sub"]

    def first(t):
        hit = next((r for r in rules if r[0].upper() in (t or "").upper()), None)
        return hit[1:] if hit else ("Other", "Other", t)

    assert [tuple(r)[1:] for r in got.collect()] == [first(t) for t in texts]
    joined = RuleTable(rules, ("grp", "mid", "sub")).join(df.union(df), "category")
    assert joined.count() == 2 * df.count() and {tuple(r)[1:] for r in joined.select("category", "grp", "mid", "sub").collect()} == {first(t) for t in texts}
    table = spark.createDataFrame([(2, "a", "second"), (1, "ab", "first"), (2, "A", "tie")], "priority int, pattern string, label string")
    assert [r[0] for r in RuleTable.read(table, ("label",)).classify(spark.createDataFrame([("xab",), ("xa",), ("x",)], "t string"), "t").select("label").collect()] == ["first", "tie", "Other"]
    with pytest.raises(ValueError):
        RuleTable([("a",)], ("label",))


def test_pruned_tree(spark):
    rows = [("G", "A", "a1", 900, 9), ("G", "A", "a2", 5, 1), ("G", "B", "B", 95, 2), ("G", "C", "c1", 4, 1), ("H", "D", "d1", 50, 1), ("H", "D", "d2", 50, 1)]
    df = spark.createDataFrame(rows, "grp string, mid string, sub string, volume long, n long")
    got = {tuple(r) for r in pruned_tree(df).collect()}
    assert got == {
        (1, "G", None, None, 1004, 13, 2), (2, "G", "A", None, 905, 10, 1), (3, "G", "A", "a1", 900, 9, 0), (2, "G", "B", None, 95, 2, 0),
        (1, "H", None, None, 100, 2, 1), (2, "H", "D", None, 100, 2, 2), (3, "H", "D", "d1", 50, 1, 0), (3, "H", "D", "d2", 50, 1, 0),
    }
    tree = sinks.nested(pruned_tree(df), ["grp", "mid", "sub"], "volume")
    assert [n["name"] for n in tree] == ["G", "H"] and [c["name"] for c in tree[0]["children"]] == ["A", "B"] and "children" not in tree[0]["children"][1]
    assert pruned_tree(df.where(F.lit(False))).count() == 0
