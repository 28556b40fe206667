"""Driver contract: entry runs; every oracle key is a query; oracles agree at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry(spark):
    df = E.entry(spark)
    assert len(df.columns) > 0 and df.count() >= 0


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.mark.parametrize("key", ["flagship_two_features", "preprocess_full", "diff_global", "ridge_path", "alert_report",
                                 "describe_numeric", "hist_auto", "history_summary", "upsert_latest"])
def test_oracle_agrees_small(spark, key):
    import math
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sp = E.queries()[key](spark, SF001).toPandas()
    dk = con.execute(E.oracle_sql()[key]).df()
    assert sorted(sp.columns) == sorted(dk.columns)

    def norm(df):
        cols = sorted(df.columns)
        out = []
        for rec in df[cols].itertuples(index=False, name=None):
            out.append(tuple(None if (isinstance(v, float) and math.isnan(v)) or v is None
                             else (round(v, 6) if isinstance(v, float) else v) for v in rec))
        return sorted(out, key=repr)
    assert norm(sp) == norm(dk)
