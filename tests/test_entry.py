import sys

import __spark_entry__ as entry
from photonframe.plans import registry


def test_core_stays_where_optional_modules_cannot_be_imported(monkeypatch):
    for name in ("photonframe.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
