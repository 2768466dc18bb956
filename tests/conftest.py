import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def duck(sql, d):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.execute(sql).df()


def same_rows(a, b):
    """Both frames have the same columns and, in any order, the same rows."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def tidy(v):
        if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
            return "-"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0) if not float(v).is_integer() else str(int(v))
        return str(v)

    rows = lambda x: sorted("|".join(tidy(v) for v in r) for r in x[cols].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)
