import importlib
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60


def test_entry_works_without_the_extra_subpackage(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("meshquery.llm", "corpus_pipeline") else found(name, *a))
    assert "wql_join" in entry.queries() and not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]


def test_library_does_not_import_the_extra_subpackage():
    import subprocess

    code = "import sys, meshquery.catalog_queries, meshquery.sources.html_data, meshquery.sources.site_files, meshquery.streaming.feeds; sys.exit(any(m.startswith('meshquery.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition('/')[0]).returncode == 0


def test_entry_works_where_an_import_of_the_extra_subpackage_fails(monkeypatch):
    had = set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("meshquery.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow.compute", None)
    assert "wql_join" in entry.queries() and not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    monkeypatch.undo()
    assert set(entry.queries()) == had
