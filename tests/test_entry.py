import importlib
import sys

import __spark_entry__ as entry
import duckdb
import pytest

from cairnspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(rounded(r[c]) for c in columns) for r in df.collect()]
    sql = con.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == columns
    want = [tuple(map(rounded, r)) for r in sql.select(*(f'"{c}"' for c in columns)).fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_training_operators_can_be_left_out(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("cairnspark.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        again = importlib.reload(entry)
        assert set(again.queries()) == set(catalog.QUERIES) and set(again.oracle_sql()) <= set(again.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
