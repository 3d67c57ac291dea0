"""Steps written to the folder that driver and executors share, so that what follows starts from a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a local session gets
    a temporary folder of its own; on a cluster that is an error, since executors wouldn't see each other's files."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="calibra-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder as Hadoop has them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: no lineage, and a lost executor costs no step before.

    The files go when the session's file systems close, or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    system, target = _folder(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``staged``, once everything that was derived from it has been written."""
    system, target = _folder(df.sparkSession, df.staged_at)
    system.delete(target, True)
