"""The queries of the training-data operators that SQL can express, against DuckDB on the smallest tables; all on their contract's columns."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from martlens.llm import queries

DATA = Path("/root/testdata/sf0.001")
CONTRACT = {
    "op1_mix": "doc_id size source_size target taken",
    "op3_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_near_duplicates": "doc_id n_shingles component_id kept",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_top_k": "query_id rank vec_id score",
    "op8_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op10_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_url_filters": "page_id host path rule verdict",
}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def rows(df: pd.DataFrame) -> list:
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v != v else float(f"{v:.8g}") if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns_come_first(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    want = CONTRACT[name].split()
    assert df.columns[: len(want)] == want
    if name not in ("op7_top_k", "op8_chat", "op11_hard_negatives", "op13_url_filters"):
        assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
