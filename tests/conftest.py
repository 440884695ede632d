import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if not isinstance(v, bool) else v


@pytest.fixture(scope="session")
def same(duck):
    """Compare a DataFrame with the rows of a SQL text, order left aside."""

    def check(df, sql):
        want = duck.execute(sql).df()
        got = df.toPandas()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = lambda x: sorted(repr([cell(v.item() if hasattr(v, "item") else v) for v in r]) for r in x[cols].itertuples(index=False))
        assert rows(got) == rows(want)

    return check
