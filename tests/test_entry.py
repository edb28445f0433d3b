import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from estima.plans import catalog

SF = "/root/testdata/sf0.01"


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_stands_alone(monkeypatch):
    """Without the optional subpackage the entry points still import and answer."""
    for name in [m for m in sys.modules if m.startswith("estima.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "estima.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    try:
        assert set(alone.queries()) == set(catalog.QUERIES) and set(alone.oracle_sql()) == set(catalog.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_a_missing_package_is_an_error(monkeypatch):
    """Only the subpackage itself may be missing, not what it imports."""
    if entry.llm is None:
        pytest.skip("the subpackage isn't there")
    for name in [m for m in sys.modules if m.startswith("estima.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "pyarrow.compute", None)
    try:
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(entry)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_duckdb(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    got = got.select(*columns).collect()
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert len(got) > 0 and plain(got) == plain(want)


def test_running_customers_over_all_days(spark):
    days = duckdb.sql(f"SELECT count(DISTINCT o_orderdate::DATE), count(DISTINCT o_custkey) FROM '{SF}/orders.parquet'").fetchall()[0]
    got = catalog.QUERIES["theta_over_window"](spark, SF).collect()
    assert (len(got), max(r["n"] for r in got)) == days
