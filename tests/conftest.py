import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from provisor.session import build_session

    session = build_session(
        "tests", "local[4]", **{
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def one(spark, value, fn, kind="string"):
    """Apply a column function to one value."""
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v")).first()[0]
