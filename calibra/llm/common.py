"""Helpers shared by the training-data operators: table access, shared-folder checkpoints, Arrow batches."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators.stage import staged

#: Where vocabulary files are looked for when no path is given.
TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file: the installed package's, or else the folder's."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: short lineage, survives lost executors."""
    return staged(df)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that nothing refers to any more, rather than when the driver's heap fills."""
    for _ in range(2):  # what the first collection lets go of refers to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts empty; other columns, whatever their names, stay behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def hashed_sample(df: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``column``, all rows if there are no more.

    A sort with a limit alone lets every task send ``most`` rows to the driver. So a share of the range of hashes that
    holds the sample with room to spare is cut out first; what is left is about as small for any number of tasks.
    """
    n = df.count()
    share = min(1.0, 1.2 * (most + 100) / max(1, n))
    place = F.shiftrightunsigned(F.xxhash64(column), 1) / F.lit(float(1 << 63))
    return df.where(place <= share).orderBy(place, column).limit(most)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``, so that Python lists stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.column(batch.schema.get_field_index(column)).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where ``work`` yields {column: values}; the columns get the types that ``schema`` names."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A memo that computes what is missing and forgets everything at ``most`` entries. Strings of over LONGEST characters
    aren't kept, so its bytes are bounded too."""

    LONGEST = 128

    def __init__(self, compute: Callable, most: int = 400_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if type(key) in (str, bytes) and len(key) > self.LONGEST:
            return self.compute(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value
