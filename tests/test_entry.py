import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF01
from grove.sources.tables import TABLES


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if (isinstance(v, float) and v != v) or v is None or v is pd.NA
                         else (float(f"{v:.9g}") if isinstance(v, float) else v) for v in r))
    return sorted(out, key=repr)


# Queries that fit forests take minutes together; tools/check_oracle.py compares them all, and the
# tests of their operators fit forests of their own.
FOREST = ("train_", "tune_", "wide_", "score_", "stream_", "model_", "save_", "pipeline_", "refit_",
          "sample_", "cv_scores")


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith(FOREST)))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF01).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_model_roundtrip_all_equal(spark):
    row = E.queries()["model_roundtrip"](spark, "/root/testdata/sf0.001").first()
    assert row.n_rows > 0 and row.n_equal == row.n_rows


def test_every_query_outside_the_text_operators_has_an_oracle():
    own = {n for n in E.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(E.oracle_sql())


def test_stream_score_covers_test_side(spark):
    d = "/root/testdata/sf0.001"
    streamed = E.queries()["stream_score"](spark, d)
    batch = E.queries()["score_batch"](spark, d)
    assert streamed.count() == batch.count() > 0
