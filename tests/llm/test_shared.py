"""The filter of keys, tables of a stage, batches."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from verdigris.llm import exact_dedup, near_copies, shared
from verdigris.llm.shared import KeyFilter, stage_tables, written


def test_key_filter_knows_every_key_and_few_others(spark):
    keys = spark.range(40_000).select(F.xxhash64("id").alias("k"))
    held = KeyFilter(keys)
    assert held.chunks == 2
    every = spark.range(80_000).select("id", held.may_have(F.xxhash64("id")).alias("hit"))
    assert every.where("id < 40000 AND NOT hit").count() == 0
    assert every.where("id >= 40000 AND hit").count() < 400
    assert spark.createDataFrame([(None,)], "k long").select(held.may_have(F.col("k")).alias("hit")).first().hit is False
    assert spark.range(50).where(KeyFilter(keys.limit(0)).may_have(F.col("id"))).count() == 0


def test_key_filter_counts_the_keys_of_a_list(spark):
    held = KeyFilter(spark.range(100).select(F.xxhash64("id").alias("k")))
    of = lambda *ids: F.transform(F.array(*map(F.lit, ids)), lambda i: F.xxhash64(i.cast("long")))
    lists = [of(1, 5_000, 2, 3), of(6_000), of(7), F.lit(None).cast("array<long>"), F.lit([]).cast("array<long>"), F.array(F.lit(None).cast("long"), F.xxhash64(F.lit(9).cast("long")))]
    rows = spark.range(1, numPartitions=1).select(F.explode(F.array(*lists)).alias("x"))
    assert [r.n for r in rows.select(held.how_many("x").alias("n")).collect()] == [3, 0, 1, 0, 0, 1]


def test_dedups_are_the_same_with_a_filter_that_lets_all_through(spark, odd, clashing, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)]
    rows = [(i, rng.choice(texts) + rng.choice(["", " end", ""])) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:20] + [(None, texts[0]), (3, None)], "doc_id long, text string")
    out = [sorted(map(str, f(d).collect())) for f in (exact_dedup.exact_dedup, near_copies.near_copy_dedup) for d in (docs, odd, clashing)]
    monkeypatch.setattr(KeyFilter, "may_have", lambda self, key: F.lit(True))
    assert out == [sorted(map(str, f(d).collect())) for f in (exact_dedup.exact_dedup, near_copies.near_copy_dedup) for d in (docs, odd, clashing)]


def test_dedups_are_the_same_without_broadcasts(spark, odd, clashing, monkeypatch):
    """Narrow tables over the bound are shuffled."""
    texts = [" ".join(f"{k}w{i}" for i in range(40)) for k in range(10)]
    rows = [(i, texts[i % 10] + " x" * (i // 20)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [sorted(map(str, f(d).collect())) for f in (exact_dedup.exact_dedup, near_copies.near_copy_dedup) for d in (docs, odd, clashing)]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    assert out == [sorted(map(str, f(d).collect())) for f in (exact_dedup.exact_dedup, near_copies.near_copy_dedup) for d in (docs, odd, clashing)]


def test_tables_of_a_stage_go_when_its_result_is_written(spark):
    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    outer = written(spark.range(2), "outer")
    with stage_tables(spark) as keep:
        inner = written(spark.range(3), "inner")
        at = folder(inner)
        result = keep(inner.where("id > 0"), "result")
        assert at.exists()
    assert not at.exists() and result.count() == 2 and outer.count() == 2
