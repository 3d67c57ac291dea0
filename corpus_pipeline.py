"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import line_dedup, packing, quality, simhash
from calibra.llm.common import materialise, table

#: A document goes if its chance of the best grade is under this: op8's own cut, so none stays that op8 marks keep = false.
KEEP_AT = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier doesn't reject."""
    return quality.select_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")), KEEP_AT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those that had nothing but white space beside go. n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    dropped = F.col(out.columns[-1])  # n_dropped, or what it's called where docs have such a column
    out = out.where((dropped == 0) | F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; one without doc_id if none has one."""
    return simhash.first_of_groups(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_dedup_stage), ("best-fit packing", packing_stage)]

#: SQL expresses neither the classifier's fit nor the fingerprints nor the packing: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
