"""Fail-fast integrity: values that can't be read while a condition is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(value: Column, broken: Column, message: str) -> Column:
    """``value``, or an error with ``message`` where ``broken`` is true. As part of a result, it can't be optimised away."""
    return F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("string").isNotNull().cast("int")).otherwise(value)


def integrity(df: DataFrame, key: str, group: str | None = None, part: str | None = None) -> DataFrame:
    """One row of counts: rows, repeated keys, and groups that occur in several parts (0 without ``group``)."""
    n = F.count(F.lit(1))
    keys = df.groupBy(key).agg(n.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("repeated"))
    if group is None:
        return keys.withColumn("overlapping", F.lit(0).cast("long"))
    spread = df.groupBy(group).agg((F.min(part) != F.max(part)).alias("spread")).agg(F.count_if("spread").alias("overlapping"))
    return keys.crossJoin(spread)  # one row each


def require(df: DataFrame, key: str, group: str | None = None, part: str | None = None) -> None:
    """Raises ValueError for an empty table, a repeated key, or a group in several parts."""
    row = integrity(df, key, group, part).first()
    if not row.n_rows:
        raise ValueError("no rows")
    if row.repeated:
        raise ValueError(f"{row.repeated} values of {key} are repeated")
    if row.overlapping:
        raise ValueError(f"{row.overlapping} values of {group} occur in several {part}s")
