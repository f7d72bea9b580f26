"""Stateful processors: keyed state of several kinds, with expiry and timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ids that an event of activity lists.
MOST_IDS = 10


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, for the queries that are started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Numbering(StatefulProcessor):
    """Numbers that rise in each space; an item keeps the number that it got first."""

    def __init__(self, space: str, item_type: str, ttl_ms: int | None) -> None:
        self.space, self.item_type, self.ttl_ms = space, item_type, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", f"item {self.item_type}", "seq long", self.ttl_ms) if self.ttl_ms else handle.getMapState("numbers", f"item {self.item_type}", "seq long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        every = pd.concat(list(rows)).sort_values(["event_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        seqs, again = [], []
        for item in every["item"].tolist():
            known = self.numbers.getValue((item,)) if self.numbers.containsKey((item,)) else None
            if known is None:
                last += 1
                self.numbers.updateValue((item,), (last,))
            seqs.append(last if known is None else known[0])
            again.append(known is not None)
        self.last.update((last,))
        yield pd.DataFrame({self.space: key[0], "event_id": every["event_id"].to_numpy(), "seq": seqs, "again": again})

    def close(self) -> None:
        pass


def numbered(events: DataFrame, space: str, ttl_ms: int | None = None) -> DataFrame:
    """(space, event_id, seq, again) from (space, event_id, item): the number of the item in its space, and whether it had one.

    Sending an item again doesn't number it anew. With ttl_ms an item is forgotten
    so many milliseconds after it was numbered; without, its number is for good.
    Rows of a batch go by event_id.
    """
    kind = events.schema["item"].dataType.simpleString()
    of_space = events.schema[space].dataType.simpleString()
    mode = "processingTime" if ttl_ms else "none"
    return events.groupBy(space).transformWithStateInPandas(Numbering(space, kind, ttl_ms), f"{space} {of_space}, event_id long, seq long, again boolean", "append", mode)


WATCH_EVENT = "poll long, kind string, count long, ids array<string>, before string, after string, message string"


def watch_rows(state: tuple | None, polls: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """The fold of a watch: state is (newest id, authority), None before the first good poll; and a row for each event."""
    out = []
    for poll, ids, authority, error, probe_error in zip(polls["poll"], polls["ids"], polls["authority"], polls["error"], polls["probe_error"], strict=True):
        if isinstance(error, str):
            out.append((poll, "poll_error", None, None, None, None, error))
            continue
        ids = [] if ids is None else list(ids)
        held = state[1] if state else None
        now = authority if isinstance(authority, str) else None
        if isinstance(probe_error, str):
            out.append((poll, "poll_error", None, None, None, None, f"authority probe: {probe_error}"))
            now = held
        newest = ids[0] if ids else state[0] if state else None
        if state is None:
            out.append((poll, "watch_started", None, ids[:1] or None, None, now, None))
        else:
            if ids:
                out.append((poll, "new_activity", len(ids), ids[:MOST_IDS], None, None, None))
            if now != held:
                out.append((poll, "authority_changed", None, None, held, now, None))
        state = (newest, now)
    return state, out


def watched(polls: DataFrame, key: str) -> DataFrame:
    """(key, poll, kind, count, ids, before, after, message) from polls (key, poll, ids newest first, authority, error, probe_error).

    The first poll without an error starts the watch and is its baseline. Later ones
    give new_activity, with their number of ids and the ten newest, if there are
    any, and authority_changed, if the authority isn't the one held; both may come of
    one poll. A poll with an error is poll_error and leaves the state as it was; one
    that couldn't tell the authority gives poll_error and keeps that held. Polls of a
    batch go by number.
    """
    names = [f.split()[0] for f in WATCH_EVENT.split(", ")]

    # The state comes and goes with a key's rows; a processor would ask for it by a call of its own.
    def each(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        frames = list(batches)
        now, out = watch_rows(held, (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values("poll", kind="stable"))
        if now is not None and now != held:
            state.update(now)
        columns = dict(zip(names, zip(*out, strict=True), strict=True))
        yield pd.DataFrame({key: [k[0]] * len(out)} | columns | {"count": pd.array(columns["count"], "Int64")}) if out else pd.DataFrame(columns=[key, *names])

    kind = polls.schema[key].dataType.simpleString()
    rows = polls.select(key, "poll", "ids", "authority", "error", "probe_error").groupBy(key)
    return rows.applyInPandasWithState(each, f"{key} {kind}, {WATCH_EVENT}", "newest string, authority string", "append", GroupStateTimeout.NoTimeout)


class SessionCap(StatefulProcessor):
    """Running spend of a session that ends after a gap; its state goes when event time has passed the gap."""

    def __init__(self, key: str, gap_ms: int, cap: float) -> None:
        self.key, self.gap, self.cap = key, gap_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "began long, last long, spent double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        every = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        began, last, spent = self.state.get() if self.state.exists() else (None, None, 0.0)
        timer = None if last is None else last + self.gap
        sessions, totals = [], []
        for at, amount in zip(every["at"].tolist(), every["amount"].tolist(), strict=True):
            if last is None or at - last >= self.gap:
                began, spent = at, 0.0
            last = at if last is None else max(last, at)
            spent += amount
            sessions.append(began)
            totals.append(spent)
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.state.update((began, last, spent))
        if last + self.gap > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + self.gap)
        yield pd.DataFrame({self.key: key[0], "event_id": every["event_id"].to_numpy(), "session": sessions, "spent": totals, "over": [t > self.cap for t in totals]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.state.exists() and self.state.get()[1] + self.gap <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_flags(spends: DataFrame, key: str, gap_seconds: int, cap: float, late: str = "0 seconds") -> DataFrame:
    """(key, event_id, session, spent, over) from (key, ts, event_id, amount): what the session has spent with this row, and whether that is over the cap.

    A session ends when nothing comes for gap_seconds; session is the millisecond at
    which it began. Rows of a batch go by time; one that comes late, but within the
    watermark, counts for the session that is open.
    """
    kind = spends.schema[key].dataType.simpleString()
    timed = spends.withWatermark("ts", late).select(key, "ts", "event_id", F.unix_millis("ts").alias("at"), F.col("amount").cast("double").alias("amount"))
    return timed.groupBy(key).transformWithStateInPandas(SessionCap(key, gap_seconds * 1000, cap), f"{key} {kind}, event_id long, session long, spent double, over boolean", "append", "eventTime")


def session_totals(spends: DataFrame, key: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """(key, start, end, rows, total) of sessions that have ended: those that no row within the watermark can still prolong."""
    w = F.session_window("ts", gap)
    out = spends.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("rows"), F.sum("amount").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "total")
