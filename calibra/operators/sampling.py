"""Samples that don't depend on partitions or the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.functions.buckets import seeded_order


def stable_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """The ``most`` rows with the smallest SHA-256 of 'seed:key', all rows if there are no more.

    A share of the hashes that holds the sample with room to spare is cut out first, so that what the tasks sort and
    send is about the sample, however many tasks there are.
    """
    order = seeded_order(seed, F.col(key))
    share = min(1.0, 1.2 * (most + 100) / max(1, df.count()))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.where(place <= share).orderBy(order, key).limit(most)


def sample_each(df: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """The ``most`` rows of each group with the smallest SHA-256 of 'seed:key'. Spark cuts groups to ``most`` in each task
    before it shuffles, so a hot group is no more to one task than tasks times ``most``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(seeded_order(seed, F.col(key)), key))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def salt(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")
