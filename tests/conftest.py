import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesflow.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("salesflow-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """rows + DDL to DataFrame; ISO texts become dates and times."""

    def make(rows, schema):
        from pyspark.sql import functions as F

        if not rows:
            return spark.createDataFrame([], schema)
        fields = [part.split() for part in schema.split(",")]
        timed = {name: kind for name, kind in fields if kind in ("date", "timestamp")}
        df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in timed else k}" for n, k in fields))
        for name, kind in timed.items():
            df = df.withColumn(name, F.col(name).cast(kind))
        return df

    return make
