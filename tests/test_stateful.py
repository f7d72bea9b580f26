"""Sinks that fail half way or come again, and stateful processors over several batches."""

from __future__ import annotations

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.sources import commits
from verdigris.streaming import sinks, stateful, streams


def summed(held, batch):
    rows = batch if held is None else held.select(*batch.columns).unionByName(batch)
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def test_bucket_table_writes_what_a_batch_touches(spark, tmp_path):
    table = sinks.BucketTable(spark, str(tmp_path), "k", buckets=16)
    assert table.read() is None
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("n")), 0, summed)
    first = table.manifest()
    assert len(first) == 16
    few = spark.createDataFrame([(3, 5), (1003, 1)], "k long, n long")
    table.upsert(few, 1, summed)
    second = table.manifest()
    assert 1 <= sum(first[b] != second[b] for b in first) <= 2
    written = sum(f.stat().st_size for f in Path(tmp_path, "data").glob("1-*/**/*.parquet"))
    assert written < 0.2 * sum(f.stat().st_size for f in Path(tmp_path, "data").glob("0-*/**/*.parquet"))
    for _ in range(2):  # the batch comes again
        table.upsert(few, 1, summed)
    assert table.manifest() == second
    assert {r.k: r.n for r in table.read().collect()} == {k: 6 if k == 3 else 1 for k in [*range(1000), 1003]}
    table.upsert(few.limit(0), 2, summed)
    assert table.manifest() == second


def test_bucket_table_after_a_failure_between_data_and_manifest(spark, tmp_path, monkeypatch):
    table = sinks.BucketTable(spark, str(tmp_path), "k", buckets=4)
    rows = spark.range(50).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    table.upsert(rows, 0, summed)
    put = commits.put_if_absent
    monkeypatch.setattr(commits, "put_if_absent", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(rows, 1, summed)
    assert {r.n for r in table.read().collect()} == {1}
    monkeypatch.setattr(commits, "put_if_absent", put)
    table.upsert(rows, 1, summed)
    assert {r.n for r in table.read().collect()} == {2} and table.read().count() == 50
    for i in range(2, 6):
        table.upsert(rows, i, summed)
    assert {r.n for r in table.read().collect()} == {6}
    assert len(commits.names(spark, f"{tmp_path}/manifests")) == 2 and len(commits.names(spark, f"{tmp_path}/data")) == 2


def test_ledger_and_delivery_show_together(spark, tmp_path, monkeypatch):
    """A crash after the ledger, and one before the record: readers see neither, and then both, once."""
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "doc_id long, source string")
    sink, held = sinks.usage_meter(f"{tmp_path}/m", "source"), sinks.Together(spark, f"{tmp_path}/m")
    sink(rows, 0)
    together = sinks.Together.write

    def half(self, batch_id, tables):
        together(self, batch_id, {"ledger": tables["ledger"], "delivery": tables["delivery"].select(F.raise_error(F.lit("lost")))})

    monkeypatch.setattr(sinks.Together, "write", half)
    with pytest.raises(Exception, match="lost"):
        sink(rows, 1)
    monkeypatch.setattr(sinks.Together, "write", together)
    put = commits.put_if_absent
    monkeypatch.setattr(commits, "put_if_absent", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sink(rows, 1)
    assert held.read("ledger").agg(F.sum("records_served")).first()[0] == held.read("delivery").count() == 30
    monkeypatch.setattr(commits, "put_if_absent", put)
    for _ in range(2):
        sink(rows, 1)
    assert held.read("ledger").agg(F.sum("records_served")).first()[0] == held.read("delivery").count() == 60


def test_records_are_whole_and_written_once(spark, tmp_path):
    path = f"{tmp_path}/r/1"
    assert not commits.exists(spark, path) and commits.names(spark, f"{tmp_path}/r") == []
    assert commits.put_if_absent(spark, path, "é\n1") and not commits.put_if_absent(spark, path, "2")
    assert commits.get(spark, path) == "é\n1" and commits.names(spark, f"{tmp_path}/r") == ["1"]
    assert commits.put_if_absent(spark, f"{tmp_path}/r/0", "") and commits.get(spark, f"{tmp_path}/r/0") == ""


def test_scan_events(spark, tmp_path):
    def scan(batch):
        return batch.select(F.lit("r").alias("rule_id"), "doc_id", F.when(F.col("text") == "bad", "fail").otherwise("pass").alias("result"), F.lit(1).alias("line"))

    sink, held = sinks.incremental_scan(f"{tmp_path}/s", scan), sinks.Together(spark, f"{tmp_path}/s")
    sink(spark.createDataFrame([(1, "bad"), (2, "ok")], "doc_id long, text string"), 0)
    sink(spark.createDataFrame([], "doc_id long, text string"), 1)
    failing = sinks.incremental_scan(f"{tmp_path}/s", lambda batch: scan(batch).where(F.raise_error(F.lit("no rules")).isNull()))
    failing(spark.createDataFrame([(3, "bad")], "doc_id long, text string"), 2)
    sink(spark.createDataFrame([(3, "bad")], "doc_id long, text string"), 2)  # the batch comes again: its events stand
    events = sorted(map(tuple, held.read("events").select("batch_id", "kind", "documents", "findings").collect()))
    assert events == [(0, "scan_complete", 2, 1), (1, "scan_complete", 0, 0), (2, "scan_error", 1, 0)]
    assert [r.doc_id for r in spark.read.parquet(*(str(p) for p in Path(tmp_path, "s", "findings").glob("*"))).collect()] == [1]


def in_batches(spark, tmp_path, parts, schema):
    """A stream that takes each part as a batch."""
    folder = f"{tmp_path}/parts"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_items_keep_their_numbers_over_batches(spark, tmp_path):
    parts = [[(1, 1, "a"), (1, 2, "b"), (2, 3, "a")], [(1, 5, "a"), (1, 4, "c"), (2, 6, "b")], [(1, 7, "b"), (1, 8, "d"), (1, 9, "d")]]
    with stateful.keyed_state(spark):
        streams.run_once(stateful.numbered(in_batches(spark, tmp_path, parts, "space long, event_id long, item string"), "space"), f"{tmp_path}/out")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/data").collect()), key=lambda r: r[1])
    assert got == [(1, 1, 1, False), (1, 2, 2, False), (2, 3, 1, False), (1, 4, 3, False), (1, 5, 1, True), (2, 6, 2, False), (1, 7, 2, True), (1, 8, 4, False), (1, 9, 4, True)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_watch_events_over_batches(spark, tmp_path):
    many = [f"s{i}" for i in range(20)]
    parts = [
        [(1, 0, None, None, "timeout", None), (1, 1, ["b", "a"], "k1", None, None), (2, 0, [], None, None, None)],
        [(1, 2, [], "k1", None, None), (1, 3, many, "k2", None, None), (2, 1, ["x"], None, None, "probe")],
        [(1, 4, ["z"], None, None, "down"), (1, 5, None, "k3", "timeout", None), (1, 6, [], "k2", None, None), (1, 7, [], None, None, None), (2, 2, None, "q", None, None)],
    ]
    schema = "id long, poll long, ids array<string>, authority string, error string, probe_error string"
    with stateful.keyed_state(spark):
        streams.run_once(stateful.watched(in_batches(spark, tmp_path, parts, schema), "id"), f"{tmp_path}/out")
    got = sorted(((r.id, r.poll, r.kind, r["count"], r.ids, r.before, r.after, r.message) for r in spark.read.parquet(f"{tmp_path}/out/data").collect()), key=str)
    want = [
        (1, 0, "poll_error", None, None, None, None, "timeout"), (1, 1, "watch_started", None, ["b"], None, "k1", None), (1, 3, "new_activity", 20, many[:10], None, None, None), (1, 3, "authority_changed", None, None, "k1", "k2", None),
        (1, 4, "poll_error", None, None, None, None, "authority probe: down"), (1, 4, "new_activity", 1, ["z"], None, None, None), (1, 5, "poll_error", None, None, None, None, "timeout"), (1, 7, "authority_changed", None, None, "k2", None, None),
        (2, 0, "watch_started", None, None, None, None, None), (2, 1, "poll_error", None, None, None, None, "authority probe: probe"), (2, 1, "new_activity", 1, ["x"], None, None, None), (2, 2, "authority_changed", None, None, None, "q", None),
    ]
    assert got == sorted(want, key=str)


def test_a_watch_whose_polls_all_fail_has_no_state():
    rows = pd.DataFrame({"poll": [1, 2], "ids": [None, None], "authority": [None, None], "error": ["x", "y"], "probe_error": [None, None]})
    state, out = stateful.watch_rows(None, rows)
    assert state is None and [o[1] for o in out] == ["poll_error"] * 2


def test_sessions_over_batches(spark, tmp_path):
    rng = random.Random(6)
    at, rows = 0, []
    for i in range(120):
        at += rng.choice([5, 20, 90])
        rows.append((rng.randrange(3), i, at, rng.randrange(10)))
    parts = [rows[:40], rows[40:80], rows[80:]]
    want, held, totals = [], {}, []
    for user, i, second, amount in rows:
        began, last, spent, n = held.get(user, (None, None, 0, 0))
        if last is None or second - last >= 100:
            if last is not None:
                totals.append((user, began, last + 100, n, spent))
            began, spent, n = second, 0, 0
        held[user] = (began, second, spent + amount, n + 1)
        want.append((user, i, began * 1000, float(spent + amount), spent + amount > 12))
    schema = "user long, event_id long, s long, amount long"
    source = in_batches(spark, tmp_path, parts, schema).withColumn("ts", F.timestamp_seconds("s"))
    with stateful.keyed_state(spark):
        streams.run_once(stateful.session_flags(source, "user", 100, 12.0), f"{tmp_path}/flags")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/flags/data").collect()), key=lambda r: r[1]) == want
    streams.run_once(stateful.session_totals(source, "user", "100 seconds"), f"{tmp_path}/totals")
    closed = [x for x in totals + [(u, b, last + 100, n, s) for u, (b, last, s, n) in held.items()] if x[2] <= rows[-1][2]]
    got = spark.read.parquet(f"{tmp_path}/totals/data").select("user", F.unix_seconds("start"), F.unix_seconds("end"), "rows", "total").collect()
    assert sorted(map(tuple, got)) == sorted(closed)


def test_keys_expire_over_batches_without_a_call_each(spark, tmp_path):
    """A key that comes again in time stays, one that comes after its time is live anew, and one that comes too late isn't."""
    parts = [[(1, 0), (2, 0), (3, 50)], [(2, 95), (3, 160)], [(4, 10), (1, 200), (5, 101)], [(6, 201)]]
    source = in_batches(spark, tmp_path, parts, "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    out = streams.expiring(source, "id", 100)
    assert "FlatMapGroupsInPandasWithState" not in out._jdf.queryExecution().analyzed().toString()
    with stateful.keyed_state(spark):
        streams.run_once(out, f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/data")
    assert {(r.id, r.at) for r in rows.where("NOT live").collect()} >= {(1, 0), (2, 95_000), (3, 50_000)}
    assert {r.id: r.live for r in streams.latest_state(rows, "id", 100).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_a_watch_has_its_state_with_its_rows(spark, tmp_path):
    """Many keys over two batches; no processor that asks for each key's state."""
    schema = "id long, poll long, ids array<string>, authority string, error string, probe_error string"
    source = in_batches(spark, tmp_path, [[(k, b, [f"{k}-{b}"], f"a{b}", None, None) for k in range(300)] for b in range(2)], schema)
    out = stateful.watched(source, "id")
    assert "TransformWithState" not in out._jdf.queryExecution().analyzed().toString()
    with stateful.keyed_state(spark):
        streams.run_once(out, f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/data").groupBy("kind").count().collect()
    assert dict(map(tuple, got)) == {"watch_started": 300, "new_activity": 300, "authority_changed": 300}


def test_outbreak_alerts_are_written_once_a_record(spark, sf):
    """What the stream writes grows with the records, not with their repositories."""
    from verdigris.plans import registry

    out = registry.queries()["stream_outbreak_alerts"](spark, sf)
    path = next(f for f in out.inputFiles() if "/streams/" in f).rsplit("/", 1)[0]
    written, records = spark.read.parquet(path).count(), spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < written <= records < out.count()
