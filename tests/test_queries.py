"""Every registered query of the reference operators against its DuckDB twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from graphloom.plans.registry import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_twin(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in ORACLES:
        assert len(set(df.columns)) == len(df.columns)
        return
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(repr(r[c]) for c in order) for r in rows) == want


def test_entry_without_llm(monkeypatch, spark):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def gone(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("graphloom.llm"):
            raise ModuleNotFoundError(name, name="corpus_pipeline" if name == "corpus_pipeline" else "graphloom.llm")
        return real(name, globals, locals, fromlist, level)

    for m in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("graphloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", gone)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and entry.entry(spark).count() >= 0
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
