"""Query name -> function of (spark, sf_dir), and query name -> DuckDB SQL."""

from calibra.plans import cohorts, datasets, hypotheses, inference, market, models, price, textflow, time  # noqa: F401  their queries register themselves
from calibra.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
