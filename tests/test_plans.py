"""How often plans read their fact tables, and that a maker has what its taker loses."""

import pytest

from calibra.registry import QUERIES

SF = "/root/testdata/sf0.001"
ONCE = {
    "win_rate_by_price": "lineitem", "maker_taker_gap_over_time": "lineitem", "category_returns": "lineitem", "category_roles": "lineitem", "clustered_se_event": "lineitem", "clustered_se_market": "lineitem",
    "conservation_checks": "lineitem", "brier_top_markets": "lineitem", "correlations": "lineitem", "calibration_mad_weekly": "events", "block_interpolation": "events", "top_two_per_event": "orders",
}


@pytest.mark.parametrize("name,table", ONCE.items())
def test_fact_table_is_read_once(spark, name, table):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert sum(f"/{table}.parquet" in line for line in final.splitlines() if "FileScan" in line) == 1, final
