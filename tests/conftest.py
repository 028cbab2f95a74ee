import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest set of tables."""
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(df, columns):
    """Rows of a pandas frame, nulls alike, in an order of their own."""
    clean = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(map(tuple, clean.values.tolist()), key=str)


@pytest.fixture(scope="session")
def same():
    def check(spark_df, duck_df):
        a, b = spark_df.toPandas(), duck_df.df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        assert rows_of(a, columns) == rows_of(b, columns)

    return check
