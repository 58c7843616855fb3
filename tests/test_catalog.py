"""Every query of the catalog against its SQL."""

import glob
import json
import os

import duckdb
import pandas as pd
import pytest

from verdictflow.plans import catalog

SF = "/root/testdata/sf0.01"


def tidy(df):
    df = df[sorted(df.columns)]
    df = df.astype({c: float for c in df if pd.api.types.is_float_dtype(df[c])}).round(6)
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = tidy(con.execute(catalog.oracle_sql()[name]).df()), tidy(catalog.queries()[name](spark, SF).toPandas())
    assert len(got) and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_documents_one_by_one(spark):
    """Each document judged alone has the outcome that it has in the table."""
    from verdictflow.functions.evaluate import evaluate

    got = {r.doc_id: r for r in catalog.documents_assessed(spark, SF).collect()}
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    assert set(got) == set(texts.index)
    for doc, text in texts.items():
        found = evaluate("note", json.dumps({"prompt": text} if text is not None else {}))["violations"]
        assert got[doc].kinds == ",".join(sorted(v[1] if v[0] == "S3" else f"{v[0]}:{v[1]}" for v in found)), doc
    assert len({r.verdict for r in got.values()}) > 1
