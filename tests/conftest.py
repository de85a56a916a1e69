import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from folioscan.session import local_session

    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from folioscan.views import Tables

    return Tables(spark, SF_DIR)


@pytest.fixture
def one(spark):
    """Evaluate a column expression over single values: one(fn, value, ...) -> list of results."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[1] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
