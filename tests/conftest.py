"""One session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import math
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    conf = {
        "spark.sql.shuffle.partitions": "3",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "3g",
        "spark.sql.maxMetadataStringLength": "2000",  # plans name all pushed filters
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(canonical(r[n]) for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Asserts that a query and its SQL have the same columns and rows."""

    def check(query, sql: str) -> None:
        names, mine = rows_of(query(spark, SF))
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        at = [columns.index(n) for n in names]
        theirs = sorted((tuple(canonical(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert len(mine) == len(theirs)
        assert mine == theirs

    return check
