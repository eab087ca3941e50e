import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """Values of both engines in one form."""
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if v != v else round(float(v), 6)
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def table_of(rows, columns):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows on the smallest tables against its SQL."""

    def check(query, sql):
        df = query(spark, SF)
        got = [r.asDict() for r in df.collect()]
        result = duck.sql(sql)
        want = [dict(zip(result.columns, r)) for r in result.fetchall()]
        assert sorted(df.columns) == sorted(result.columns)
        assert table_of(got, df.columns) == table_of(want, result.columns)

    return check
