import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, equal texts, a repeated row, and columns whose names operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("key", "doc", "data", "bucket", "component", "digest", "start", "ids", "spans", "range"):
        df = df.selectExpr("*", f"cast(doc_id as string) AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(some):
    return {r["doc_id"]: r["text"] for r in some.collect()}
