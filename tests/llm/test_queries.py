"""Registered corpus queries on the smallest tables: against DuckDB where it can say, and the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple("~" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["op1_warc", "op3_urlfilter", "op6_decontaminate", "op8_topk", "op11_mixing", "op12_fim", "op13_trie", "base_pii", "base_secrets", "base_licenses"])
def test_equals_sql(spark, name):
    from tidegauge.llm import queries

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(queries.ORACLES[name]).fetchdf())


def test_pipeline(spark):
    import brute
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(left) <= set(have)
        if name == "near-duplicates":
            want = brute.near_duplicates(sorted(have.items()), 5, 80)
            assert set(left) == {d for d, (_, _, kept) in want.items() if kept}
        if name == "personal-data":
            assert set(left) == set(have) and all(brute.pii(t)[:4] == (0, 0, 0, 0) for t in left.values())
        have = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(have)
