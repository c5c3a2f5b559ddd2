from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    made = made.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def against_sql(spark, sf_dir):
    """Compares a query with its SQL as multisets of rows."""
    import math
    from collections import Counter

    import duckdb

    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from '{file}'")

    def text(v):
        return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)

    def compare(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        rows = Counter(tuple(text(r[c]) for c in columns) for r in df.collect())
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(text(r[names.index(c)]) for c in columns) for r in found.fetchall())

    return compare
