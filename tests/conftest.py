import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return lambda name: f"{tmp_path}/{name}"


@pytest.fixture
def one(spark):
    """Value of a Column built from one text."""

    def value(text, build):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("v")).first()["v"]

    return value
