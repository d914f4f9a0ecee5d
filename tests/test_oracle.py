"""All queries of the registry against their DuckDB SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from martlens import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if hasattr(v, "year"):
            return str(v)[:10]
        if pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(f"{v:.8g}") if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_imports_without_the_optional_part():
    import __spark_entry__

    assert "ag01_mart_daily_store" in __spark_entry__.queries()
