import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables():
    """A DuckDB connection with the smallest test tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows as a sorted list of comparable tuples, columns by name."""

    def norm(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return f"{float(v):.9g}"
        if isinstance(v, dict):
            return norm(tuple(v.values()))
        if hasattr(v, "__iter__") and not isinstance(v, (str, bytes)):
            return tuple(norm(x) for x in v)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, tables):
    def check(query, sql):
        df = query(spark, f"{DATA}/sf0.001")
        got = [tuple(r) for r in df.collect()]
        con = tables.execute(sql)
        names = [d[0] for d in con.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, got) == rows_of(names, con.fetchall())

    return check
