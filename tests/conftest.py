"""One Spark session for all tests; DuckDB views of the small test tables."""

from __future__ import annotations

import glob
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "NULL" if v is None else str(v)


def sorted_rows(rows, names, order) -> list[tuple[str, ...]]:
    at = [names.index(n) for n in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Assert that a registered query equals its SQL in DuckDB, names, types and values."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def check(query, sql):
        df = query(spark, data)
        ours = df.collect()
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
        assert {c: kinds.get(t, theirs[c]) for c, t in df.dtypes} == theirs
        order = sorted(df.columns)
        assert sorted_rows(ours, df.columns, order) == sorted_rows(rel.fetchall(), rel.columns, order)

    return check
