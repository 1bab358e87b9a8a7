import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers import the package by path.
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """SQL over the tables of a folder, as (columns, rows)."""
    import glob

    import duckdb

    def run(sql: str, folder: str = SMALL):
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
        result = con.execute(sql)
        return [c[0] for c in result.description], result.fetchall()

    return run


@pytest.fixture(scope="session")
def agree(spark, oracle):
    """Hold a query against its SQL, rows in any order and columns by name."""

    def check(query, sql: str, folder: str = SMALL):
        df = query(spark, folder)
        columns, want = oracle(sql, folder)
        assert sorted(df.columns) == sorted(columns)
        order = [columns.index(c) for c in df.columns]
        got = sorted(map(tuple, df.collect()), key=str)
        assert got == sorted((tuple(r[i] for i in order) for r in want), key=str)

    return check
