import importlib
import sys

import pytest


def test_names_and_columns_of_oracles(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = importlib.import_module("__spark_entry__").entry(spark).collect()
    known = [f for r in rows for f in r.faces if f.person_id != "unknown"]
    assert len(rows) == 250 and len(known) == 5 and all(not r.faces for r in rows if r.frame_index % 6 == 5)


def test_entry_without_training_data_package(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("facejobs.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name=name)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith(("facejobs.llm", "corpus_pipeline", "__spark_entry__"))}
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        entry = importlib.import_module("__spark_entry__")
        assert "identify" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    finally:
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(kept)


if __name__ == "__main__":
    pytest.main([__file__])
