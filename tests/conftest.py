from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(v):
    import datetime
    import decimal
    import math

    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def same(df, con, sql) -> None:
    cols = sorted(df.columns)
    got = sorted((tuple(canonical(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(canonical(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want
