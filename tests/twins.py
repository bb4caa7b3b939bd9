"""Holds a registered query against its DuckDB twin."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 7)
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    return v if isinstance(v, (bool, int)) else str(v)


def _rows(frame, columns):
    return Counter(tuple(map(_plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


def same(spark, query, sql, sf_dir=SMALL):
    got = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _rows(got, columns) == _rows(want, columns)
