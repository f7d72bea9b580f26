from __future__ import annotations

import __spark_entry__
from verdigris.llm import queries


def test_entry_has_each_operator_and_the_pipeline():
    names = set(__spark_entry__.queries())
    assert names >= set(queries.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
