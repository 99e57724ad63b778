from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    from feedlens.session import build_session

    session = build_session(
        "feedlens-tests",
        "local[*]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluates a column expression over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(make, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
        return [r[0] for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").select("x").collect()]

    return run
