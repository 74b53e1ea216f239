import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.fixture(scope="session")
def same(spark, con):
    """Run a query beside its SQL on the smallest tables."""
    from compare import rows

    def check(query, sql):
        df = query(spark, "/root/testdata/sf0.001")
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        res = con.execute(sql)
        columns = [c[0] for c in res.description]
        assert sorted(df.columns) == sorted(columns)
        want = rows(columns, res.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
