import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def by_sql():
    """Runs SQL on the tables of a folder in DuckDB; returns column names and rows."""
    import duckdb

    def run(sql, folder):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for f in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        found = con.execute(sql)
        return [d[0] for d in found.description], found.fetchall()

    return run


def plain_value(x):
    """One value as both engines would show it."""
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return [plain_value(y) for y in x]
    if isinstance(x, dict):
        return sorted((str(k), plain_value(v)) for k, v in x.items())
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return int(x) if isinstance(x, int) else str(x)


@pytest.fixture(scope="session")
def same():
    """Asserts that a DataFrame has the columns and rows of an SQL result, in any order."""

    def check(df, names, rows):
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        own = sorted((repr([plain_value(r[c]) for c in order]) for r in df.collect()))
        at = [names.index(c) for c in order]
        theirs = sorted(repr([plain_value(r[i]) for i in at]) for r in rows)
        odd = [(a, b) for a, b in zip(own, theirs) if a != b][:3]
        assert len(own) == len(theirs), (len(own), len(theirs), odd)
        assert not odd, odd

    return check
