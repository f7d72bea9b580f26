from __future__ import annotations

import __spark_entry__
from verdigris.plans import registry


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["rec_no", "trap_id"]
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())
