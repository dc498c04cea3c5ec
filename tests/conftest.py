import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for file in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    """A value in a form that compares across engines."""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if isinstance(value, dict):
        return str({k: plain(x) for k, x in value.items()})
    return str(value)


def rows_of(df, *columns):
    """Sorted rows of a DataFrame as tuples."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def same_as_sql(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
    return got
