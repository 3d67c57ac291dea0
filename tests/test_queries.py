"""Every query against its SQL, and the conservation laws."""

import pytest

from calibra.registry import ORACLE_SQL, QUERIES
from tests.parity import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    assert compare(spark, db, QUERIES[name], ORACLE_SQL[name], SF) is None


#: Queries that SQL can't express, and the tests that hold their values to plain Python or numpy.
ELSEWHERE = {
    "event_bootstrap": "test_cohorts", "ridge_scores": "test_models", "model_sizes": "test_models", "heldout_predictions": "test_models", "correction_histogram": "test_models", "model_comparison": "test_models",
    "text_vectors": "test_textflow", "text_centres": "test_textflow", "text_assignments": "test_textflow", "assignment_coverage": "test_textflow", "cluster_support": "test_textflow",
}


def test_every_query_has_a_test():
    assert set(QUERIES) - set(ORACLE_SQL) == set(ELSEWHERE)


def test_conservation(spark):
    row = QUERIES["conservation_checks"](spark, SF).first()
    assert row.positions == 2 * row.wins and row.pnl_cents == 0


def test_decomposition_adds_up(spark):
    r = QUERIES["decomposition"](spark, SF).first()
    assert abs(r.by_price + r.by_direction + r.by_execution - r.total) < 1e-7


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "win_rate_by_price" in e.queries()
