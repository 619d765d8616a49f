import importlib
import sys

from tidemark.plans.queries import ORACLE, QUERIES


def test_entry_without_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and entry.oracle_sql() == ORACLE
    sys.modules.pop("__spark_entry__")


def test_sql_belongs_to_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["inode", "stripe_id", "seq", "logical_off", "length", "tier", "segment_id", "segment_offset"]
