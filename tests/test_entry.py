from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from lumora.plans.oracles import ORACLES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins_agree(spark, name):
    con = duckdb.connect()
    for t in Path(D).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    own, twin = e.queries()[name](spark, D).toPandas(), con.sql(e.oracle_sql()[name]).df()
    key = sorted(own.columns)
    assert key == sorted(twin.columns)
    shown = lambda v: "none" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    text = lambda f: sorted(tuple(map(shown, r)) for r in f[key].astype(object).itertuples(index=False))
    assert text(own) == text(twin)


def test_entry(spark):
    assert e.entry(spark).count() == 40
