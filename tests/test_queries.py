"""Every query with SQL against DuckDB over the smallest tables."""

import datetime
import decimal
import os
import sys
import warnings

import duckdb
import pytest

import __spark_entry__
from trackfields import queries as own

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (decimal.Decimal, bool)):
        return float(v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("broken", ["trackfields.llm.queries", "public_tokenizers", "corpus_pipeline"])
def test_entry_survives_what_cannot_be_imported(monkeypatch, broken):
    every = set(__spark_entry__.queries())
    for name in [n for n in sys.modules if n.startswith("trackfields.llm") or n in ("corpus_pipeline", broken)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, broken, None)  # importing it raises ImportError
    monkeypatch.setattr(warnings, "warn", lambda *a, **k: None)
    left = set(__spark_entry__.queries())
    gone = {"pipeline"} if broken == "corpus_pipeline" else {n for n in every if n not in own.QUERIES}
    assert left == every - gone and set(__spark_entry__.oracle_sql()) <= left
