"""Running values in ranges against plain ones, with a hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators.running import running


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_values_with_a_hot_key_ties_and_nulls(spark, how):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(400), i, rng.choice([None, *range(-5, 20)])) for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)
    got = {r.id: r.running for r in running(table, "k", ["t", "id"], "v", how).collect()}
    held, want = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        now = held.get(k)
        if how == "sum":
            held[k] = (now or 0) + (v or 0)
        elif v is not None:
            held[k] = v if now is None else max(now, v)
        want[i] = held.get(k, 0 if how == "sum" else None)
    assert got == want


def test_a_hot_key_is_in_many_ranges(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("t"), "id")
    out = running(rows, "k", ["t"], "t")
    assert sorted(r.running for r in out.collect()) == list(range(1, 4001))
    assert running(rows.limit(0), "k", ["t"], "t").count() == 0
