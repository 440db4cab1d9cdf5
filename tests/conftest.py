import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(df, sql):
        want = duck.sql(sql)
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols
        got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
        assert got == sorted(map(repr, want.select(*[f'"{c}"' for c in cols]).fetchall()))

    return check
