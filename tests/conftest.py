import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query with its SQL over the same tables, columns by name, rows without order."""
    import math

    import duckdb

    def text(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)

    def table(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)

    def compare(spark, folder, query, sql):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
        df = query(spark, folder)
        got = table(df.columns, [tuple(r) for r in df.collect()])
        done = con.execute(sql)
        assert got == table([c[0] for c in done.description], done.fetchall())

    return compare
