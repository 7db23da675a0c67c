import importlib
import sys

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score", "rerank_score"]


def test_imports_without_the_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lakeseek.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lakeseek.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.import_module("__spark_entry__")
    assert "hybrid_topk" in again.queries() and not any(n.startswith("op") for n in again.queries())
