import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(rows, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Hold a query against its SQL: columns, rows and values."""

    def check(query, sql):
        got = query(spark, sf_dir)
        want = duck.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        names = want.columns
        expected = [dict(zip(names, r)) for r in want.fetchall()]
        assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of(expected, columns)

    return check
