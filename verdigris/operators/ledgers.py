"""Usage ledgers whose rows hold the digest of the row before, and states that age."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import canonical_json
from verdigris.sources.tables import bounded_batches

GENESIS = "0" * 64


def canonical(with_query: bool = False) -> Column:
    """The text of an entry: its fields by name, in order, and the digest before it; a query of any depth in its one form."""
    head = F.to_json(F.struct(F.col("buyer"), F.col("prev_hash").alias("prevHash")))
    tail = F.to_json(F.struct(F.col("records_served").alias("recordsServed"), F.col("seq"), F.col("tier")))
    if not with_query:
        return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(tail, F.lit(2), F.length(tail)))
    asked = F.coalesce(F.concat(F.lit('"query":'), canonical_json(F.col("query")), F.lit(",")), F.lit(""))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), asked, F.substring(tail, F.lit(2), F.length(tail)))


def usage_chain_build(entries: DataFrame) -> DataFrame:
    """(ledger, seq, buyer, tier, records_served, prev_hash, hash, and query if entries have it): a chain for each ledger.

    A row's digest needs the one before: a fold for each ledger. Ledgers of a
    partition follow each other in its batches, so none is held whole and none costs
    a call of its own. query is JSON text of any depth; equal values have equal
    digests however they are written. Without one, or if it is no JSON, an entry has
    none.
    """
    with_query = "query" in entries.columns
    inner = lambda c, name: (lambda x: F.substring(x, F.lit(2), F.length(x) - 2))(F.to_json(F.struct(F.col(c).alias(name))))
    parts = F.struct(
        F.when(F.col("buyer").isNotNull(), F.concat(inner("buyer", "buyer"), F.lit(","))).alias("buyer"), (canonical_json(F.col("query")) if with_query else F.lit(None).cast("string")).alias("query"),
        F.when(F.col("records_served").isNotNull(), F.concat(inner("records_served", "recordsServed"), F.lit(","))).alias("served"), F.when(F.col("tier").isNotNull(), F.concat(F.lit(","), inner("tier", "tier"))).alias("tier"),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, before, i = object(), GENESIS, 0
        for batch in batches:
            seq, prev, hashes = [], [], []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if key != ledger:
                    ledger, before, i = key, GENESIS, 0
                asked = f'"query":{part["query"]},' if part["query"] is not None else ""
                text = f'{{{part["buyer"] or ""}"prevHash":"{before}",{asked}{part["served"] or ""}"seq":{i}{part["tier"] or ""}}}'
                prev.append(before)
                seq.append(i)
                before, i = hashlib.sha256(text.encode()).hexdigest(), i + 1
                hashes.append(before)
            own = [pa.array(seq, pa.int64()), *(batch.column(c) for c in ("buyer", "tier", "records_served")), pa.array(prev, pa.string()), pa.array(hashes, pa.string()), *([batch.column("query")] if with_query else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names)

    names = ["ledger", "seq", "buyer", "tier", "records_served", "prev_hash", "hash", *(["query"] if with_query else [])]
    kinds = {"ledger": "long", "seq": "long", "buyer": "long", "tier": "string", "records_served": "long"} | ({"query": "string"} if with_query else {})
    bounded_batches(entries.sparkSession)
    told = entries.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), parts.alias("_parts"))
    ordered = told.repartition("ledger").sortWithinPartitions("ledger", F.asc_nulls_last("seq"))
    return ordered.mapInArrow(fold, "ledger long, seq long, buyer long, tier string, records_served long, prev_hash string, hash string" + ", query string" * with_query)


def usage_chain_verify(chain: DataFrame) -> DataFrame:
    """(ledger, rows, broken_at, reason): the first break of each ledger: bad-sequence, broken-chain or bad-hash.

    Each row is held against the stored digest of the one before, so rows are
    checked side by side.
    """
    w = W.partitionBy("ledger").orderBy("seq")
    rows = chain.withColumns({"_place": F.row_number().over(w) - 1, "_before": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))})
    reason = F.when(F.col("seq") != F.col("_place"), "bad-sequence").when(F.col("prev_hash") != F.col("_before"), "broken-chain").when(F.col("hash") != F.sha2(canonical("query" in chain.columns), 256), "bad-hash")
    return rows.withColumn("_reason", reason).groupBy("ledger").agg(F.count("*").alias("rows"), F.min(F.when(F.col("_reason").isNotNull(), F.col("seq"))).alias("broken_at"), F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("seq"))).alias("reason"))


def change_points(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the one before of their key; a key's first row is its baseline."""
    w = W.partitionBy(key).orderBy(*order)
    rows = events.withColumns({"_place": F.row_number().over(w), "before": F.lag(value).over(w)})
    return rows.where((F.col("_place") > 1) & ~F.col("before").eqNullSafe(F.col(value))).drop("_place")


def staleness(writes: DataFrame, watched: DataFrame, now: int, most: int) -> DataFrame:
    """(id, status) of watched ids: FRESH if the latest write (id, at) is at most so old, else STALE; NO_HISTORY without one."""
    last = writes.groupBy("id").agg(F.max("at").alias("at"))
    return watched.select("id").distinct().join(last, "id", "left").select("id", F.when(F.col("at").isNull(), "NO_HISTORY").when(F.lit(now) - F.col("at") <= most, "FRESH").otherwise("STALE").alias("status"))


def ttl_valid(entries: DataFrame, ttl: int, now: int) -> DataFrame:
    """Entries (id, at) younger than ttl; with ttl 0 or less, or without a time, none."""
    return entries.where(F.lit(ttl > 0) & F.col("at").isNotNull() & (F.lit(now) - F.col("at") < ttl))


def event_bounds(batches: DataFrame, most_events: int = 500, most_chars: int = 2000) -> DataFrame:
    """(batch, reason) from rows (batch, rule_id, detail): malformed, too-many-events, oversized-event or ok."""
    big = (F.length("rule_id") > most_chars) | (F.length("detail") > most_chars) | (F.coalesce(F.length("rule_id"), F.lit(0)) == 0) | F.col("detail").isNull()
    out = batches.groupBy("batch").agg(F.count("*").alias("n"), F.bool_or(big).alias("big"))
    return out.select("batch", F.when(F.col("n") > most_events, "too-many-events").when(F.col("big"), "oversized-event").otherwise("ok").alias("reason"))
