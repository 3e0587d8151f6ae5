import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reportloom.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate a column over one text."""
    def evaluate(column_of, text):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(column_of(F.col("t")).alias("x")).first().x
    return evaluate
