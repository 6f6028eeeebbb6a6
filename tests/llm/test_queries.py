"""Registered queries: those with SQL give DuckDB's rows; held-out quality of the learned ones on the small data."""

import os

import duckdb
import pytest

from duelframe.catalog.checks import TABLES, canonical
from duelframe.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import pandas as pd

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    ours = canonical(pd.DataFrame([list(r) for r in df.collect()], columns=df.columns, dtype=object))
    found = con.execute(ORACLES[name])
    theirs = canonical(pd.DataFrame(found.fetchall(), columns=[d[0] for d in found.description], dtype=object))
    assert ours == theirs


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = QUERIES["op4_language_id"](spark, SF_DIR).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_model_beats_its_base(spark):
    rows = QUERIES["op6_lm_scoring"](spark, SF_DIR).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
