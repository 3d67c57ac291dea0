import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, an empty text, repeated rows, a long text, ties, and extra columns with clashing names."""
    prose = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [
        (1, prose, 1), (2, prose, 2), (3, prose + " iota", 3), (4, None, 4), (5, "", 5), (None, prose, 6), (None, None, 7),
        (6, "one two", 8), (6, "one two", 8), (7, " ".join(f"w{i}" for i in range(30_000)), 9), (8, "  \n\t \n", 10), (9, "ünï <|endoftext|> 日本 \x1c x", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumnsRenamed({}).selectExpr("doc_id", "text", "fp", "fp AS component_id", "fp AS piece", "fp AS n_lines_", "'x' AS part")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
