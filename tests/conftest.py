import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="tagsmith-tests-")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def agree(spark):
    """Whether a query and its SQL give the same rows."""
    import duckdb

    def check(query, sql: str, folder: str = DATA) -> int:
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        df, want = query(spark, folder), con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        at = [want.columns.index(n) for n in names]
        left = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
        right = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
        assert left == right
        return len(left)

    return check
