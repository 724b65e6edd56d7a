import importlib
import sys

import pytest


def test_queries_and_sql_have_the_same_names():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry_without_the_llm_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("changelens.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "changelens.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "c08_scores" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["p02_current_file", "d05_dependencies", "k05_chains", "g10_catch_up", "i04_check_in_delta"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    from changelens.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = QUERIES[name](spark, d)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
