import sys

import pytest

import __spark_entry__ as entry
from docgraph.plans import queries as q


def test_registered():
    assert set(q.SQL) <= set(q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("docgraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("docgraph.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert set(entry.queries()) == set(q.QUERIES)


@pytest.mark.parametrize("name", ["entry"])
def test_flagship(spark, name):
    rows = getattr(entry, name)(spark)
    assert rows.columns == ["c_custkey", "c_name", "n_orders", "total", "first_orders"] and rows.count() == 150
