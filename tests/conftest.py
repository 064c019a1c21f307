import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


DATA = Path("/root/testdata/sf0.001")


def rows_of(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in found), key=repr)


def compare(spark, queries, oracles, name):
    """The query's rows against the oracle's in DuckDB, on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries[name](spark, str(DATA))
    cursor = con.execute(oracles[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cursor.fetchall(), columns)
