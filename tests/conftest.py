import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the smallest tables and compares the rows."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def same(f, sql):
        df = f(spark, DATA)
        cols = sorted(df.columns)
        tidy = lambda v: round(v, 9) if isinstance(v, float) else v
        got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(tidy(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
        assert got == want

    return same
