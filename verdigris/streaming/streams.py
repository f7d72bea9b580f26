"""Structured Streaming forms of the incremental operators, and the per-key folds behind them.

Each takes a streaming (or batch) DataFrame and returns one; sinks are foreachBatch
writers that do the same again for a batch that is replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, whether the table is a file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    still = spark.read.parquet(path)
    single = [f for f in still.inputFiles() if f.endswith(f"/{name}.parquet")]
    reader = spark.readStream.schema(still.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def run_once(stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Take all that is there now, with checkpoint and result under out."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{out}/data")
    writer.start().awaitTermination()


def dedup_events(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Events of a key once. State is bounded: a repeat that comes later than the watermark isn't known any more."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def outbreak_alerts(records: DataFrame, deps: DataFrame) -> DataFrame:
    """Records as they come, joined to the repositories that depend on them; deps is a table."""
    return records.withColumn("_name", F.lower("sdk_name")).join(deps.withColumn("_name", F.lower("dep")), "_name").drop("_name")


def change_rows(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """The fold of change detection: (last value, changes so far), and a row for each change after the first observation."""
    last, n = state if state else (None, 0)
    out = []
    first = state is None
    for event_id, value in zip(rows["event_id"], rows["value"], strict=True):
        if not first and value != last:
            n += 1
            out.append((int(event_id), last, value, n))
        last, first = value, False
    return (last, n), out


def change_detect(events: DataFrame, key: str) -> DataFrame:
    """(key, event_id, before, after, n) from (key, event_id, value): the first observation of a key is its baseline."""

    def each(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("event_id")
        now, out = change_rows(state.get if state.exists else None, rows)
        state.update(now)
        yield pd.DataFrame({key: [k[0]] * len(out), "event_id": [o[0] for o in out], "before": [o[1] for o in out], "after": [o[2] for o in out], "n": [o[3] for o in out]})

    kind = events.schema["value"].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(each, f"{key} long, event_id long, before {kind}, after {kind}, n long", f"last {kind}, n long", "append", GroupStateTimeout.NoTimeout)


def limit_rows(state: tuple | None, seconds: list[float], most: int, width: float) -> tuple[tuple, list[tuple[bool, float]]]:
    """The fold of a fixed window that begins at a key's first hit: (count, reset), and (allowed, wait) for each hit."""
    count, reset = state if state else (0, float("-inf"))
    out = []
    for t in seconds:
        if t >= reset:
            count, reset = 0, t + width
        count += 1
        out.append((count <= most, 0.0 if count <= most else reset - t))
    return (count, reset), out


def rate_limit(hits: DataFrame, key: str, most: int, width: float) -> DataFrame:
    """(key, event_id, allowed, wait) from (key, event_id, seconds)."""

    def each(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["seconds", "event_id"])
        now, out = limit_rows(state.get if state.exists else None, rows["seconds"].tolist(), most, width)
        state.update(now)
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "allowed": [o[0] for o in out], "wait": [o[1] for o in out]})

    return hits.groupBy(key).applyInPandasWithState(each, f"{key} long, event_id long, allowed boolean, wait double", "count long, reset double", "append", GroupStateTimeout.NoTimeout)


def rate_limit_batch(hits: DataFrame, key: str, most: int, width: float) -> DataFrame:
    """The same over a table: a fold for each key, as each window begins where the last one let it."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seconds", "event_id"])
        _, out = limit_rows(None, rows["seconds"].tolist(), most, width)
        return pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "allowed": [o[0] for o in out], "wait": [o[1] for o in out]})

    return hits.groupBy(key).applyInPandas(each, f"{key} long, event_id long, allowed boolean, wait double")


def seq_assign(events: DataFrame, space: str) -> DataFrame:
    """(space, event_id, seq): numbers that rise in each space over all batches."""

    def each(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("event_id")
        last = state.get[0] if state.exists else 0
        state.update((last + len(rows),))
        yield pd.DataFrame({space: k[0], "event_id": rows["event_id"], "seq": range(last + 1, last + len(rows) + 1)})

    return events.groupBy(space).applyInPandasWithState(each, f"{space} long, event_id long, seq long", "seq long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, rule, n) by event time; a window closes when the watermark has passed it."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def expiring(events: DataFrame, key: str, width: int, late: str = "0 seconds") -> DataFrame:
    """(key, at, live) from (key, ts): a live row for each row of a key, and one that isn't when event time has gone on by more than width seconds since the last.

    A key's times until it expires are a session; state is the session of each live
    key, and gone with it. Keys cost no call to Python.
    """
    timed = events.select(key, F.timestamp_millis(F.unix_millis("ts")).alias("ts"))
    seen = timed.select(key, F.unix_millis("ts").alias("at"), F.lit(True).alias("live"))
    over = timed.withWatermark("ts", late).groupBy(key, F.session_window("ts", f"{width * 1000 + 1} milliseconds")).agg(F.max(F.unix_millis("ts")).alias("at"))
    return seen.unionByName(over.select(key, "at", F.lit(False).alias("live")))


def latest_state(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, live) from what expiring() gave: a key is live unless its last row says that it isn't, or came late and was over already."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("at", "live"), F.struct("at", (~F.col("live")).alias("over"))).alias("_last"))
    now = rows.agg(F.max("at").alias("_now"))
    return last.join(F.broadcast(now)).select(key, (F.col("_last.live") & (F.col("_now") - F.col("_last.at") <= width * 1000)).alias("live"))


def accept_rows(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[bool]]:
    """The fold of policies: (version, admins), and whether each row is accepted."""
    version, admins = state if state else (None, ())
    out = []
    for v, signer, named in zip(rows["version"], rows["signer"], rows["admins"], strict=True):
        ok = version is None or (v > version and signer in admins)
        if ok:
            version, admins = int(v), tuple(int(a) for a in named)
        out.append(bool(ok))
    return (version, list(admins)), out


def policy_stream(rows: DataFrame) -> DataFrame:
    """policy_versions() over a stream: rows of a space go by id in a batch, and after those of the batches before."""

    def each(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        space = pd.concat(batches).sort_values("id")
        now, out = accept_rows(state.get if state.exists else None, space)
        state.update(now)
        yield pd.DataFrame({"space": k[0], "id": space["id"], "accepted": out})

    return rows.groupBy("space").applyInPandasWithState(each, "space long, id long, accepted boolean", "version long, admins array<long>", "append", GroupStateTimeout.NoTimeout)


def policy_versions(rows: DataFrame) -> DataFrame:
    """(space, id, accepted) from (space, id, version, signer, admins): a version must rise and its signer be an admin of the policy before; the first is trusted."""

    def fold(space: pd.DataFrame) -> pd.DataFrame:
        space = space.sort_values("id")
        _, out = accept_rows(None, space)
        return pd.DataFrame({"space": space["space"], "id": space["id"], "accepted": out})

    return rows.groupBy("space").applyInPandas(fold, "space long, id long, accepted boolean")
