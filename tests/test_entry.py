from __future__ import annotations

import importlib

import duckdb
import pytest

import __spark_entry__
from quillvec import queries as vector_queries

CHECKED = ["knn_exact_l2", "knn_scaled_cosine", "filter_nested", "recall_by_distance", "medoid_per_label", "alpha_prune_strict", "incr_search_merged", "pq_encode"]


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(vector_queries.ORACLE_SQL) <= set(vector_queries.QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    df = vector_queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    found = con.execute(vector_queries.ORACLE_SQL[name])
    places = [[d[0] for d in found.description].index(n) for n in names]
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(str(tuple(r[i] for i in places)) for r in found.fetchall())


def test_nothing_but_the_entry_names_the_text_operators():
    for module in ("queries", "functions.distance", "operators.knn", "plans.index", "sources.vecs", "streaming.ingest"):
        with open(importlib.import_module(f"quillvec.{module}").__file__) as f:
            assert "llm" not in f.read()
