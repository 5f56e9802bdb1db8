import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(frame):
    """A frame's rows as sorted texts, columns by name; whole floats as integers, nulls alike."""
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(str([clean(v) for v in r]) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(frame, sql):
        got, want = frame.toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
