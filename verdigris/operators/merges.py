"""De-duplication, merges, set operations and sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDENTITY = ("trap_id", "sdk_name", "sdk_version")


def _richness(order: str) -> Column:
    """The larger of two copies by this is the richer: payload, then corroboration, then the earlier one."""
    return F.struct((F.length("snippet") > 0).alias("payload"), F.coalesce("corroboration", F.lit(0)).alias("corroboration"), (-F.col(order)).alias("order"))


def richest_copy(records: DataFrame, key: tuple[str, ...] = IDENTITY, order: str = "rec_no") -> DataFrame:
    """One record a key. max_by combines before the shuffle: a key that many share is no hot task."""
    rest = [c for c in records.columns if c not in key]
    best = records.groupBy(*key).agg(F.max_by(F.struct(*rest), _richness(order)).alias("_best"))
    return best.select(*key, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*records.columns)


def upsert_merge(held: DataFrame, new: DataFrame, key: tuple[str, ...] = IDENTITY) -> DataFrame:
    """(key, corroboration, snippet, outcome) after new rows are merged: added, updated or unchanged.

    Each side has a row a key. A richer new row replaces the held one; its payload
    is carried forward if it has none, and corroboration is the larger of both.
    """
    a, b = held.alias("a"), new.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    both = a.join(b, on, "full_outer")
    had, has = F.col("a.rec_no").isNotNull(), F.col("b.rec_no").isNotNull()
    full = lambda side: F.length(F.col(f"{side}.snippet")) > 0
    seen = lambda side: F.coalesce(F.col(f"{side}.corroboration"), F.lit(0))
    richer = had & has & ((full("b") & ~full("a")) | ((full("b") == full("a")) & (seen("b") > seen("a"))))
    outcome = F.when(~had, "added").when(richer, "updated").when(has, "unchanged").otherwise("kept")
    take_new = ~had | richer
    pick = lambda c: F.when(take_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(*(pick(c).alias(c) for c in key), F.when(richer, F.greatest(seen("a"), seen("b"))).otherwise(pick("corroboration")).alias("corroboration"), F.when(richer & ~full("b"), F.col("a.snippet")).otherwise(pick("snippet")).alias("snippet"), outcome.alias("outcome"))


def insert_if_absent(held: DataFrame, new: DataFrame, key: str = "trap_id") -> DataFrame:
    """The rows of new whose key isn't held."""
    return new.join(held.select(key).distinct(), key, "left_anti").select(*new.columns)


def event_idempotent_append(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key is neither held nor earlier in new (by event_id)."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), "event_id").alias("_first")).select(*key, "_first.*")
    known = held.select(*key).distinct()
    on = [first[c].eqNullSafe(known[c]) for c in key]
    return first.join(known, on, "left_anti").select(*new.columns)


def last_write_upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def packaging_sync(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(only_a, only_b, in_sync) of two key sets."""
    left, right = a.select(*key).distinct().withColumn("_a", F.lit(1)), b.select(*key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")).withColumn("in_sync", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def rule_precedence(rules: DataFrame) -> DataFrame:
    """rules (rule_id, source_rank) with shadowed: another source of a lower rank has the id."""
    first = rules.groupBy("rule_id").agg(F.min("source_rank").alias("_rank"))
    return rules.join(first, "rule_id").withColumn("shadowed", F.col("source_rank") > F.col("_rank")).drop("_rank")


def seq_assign(held: DataFrame, new: DataFrame, space: str, key: list[str], order: list[str]) -> DataFrame:
    """New events with seq, rising from the last of their space; a key that is held or repeated gets none.

    held has (space, key, seq). Numbers are per space, so a space is numbered by
    one task: its order has no other meaning.
    """
    fresh = event_idempotent_append(held, new, [space, *key])
    last = held.groupBy(space).agg(F.max("seq").alias("_last"))
    number = F.row_number().over(W.partitionBy(space).orderBy(*order))
    return fresh.join(last, space, "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + number).cast("long")).drop("_last")


def seq_delta_read(events: DataFrame, space: str, cursors: DataFrame) -> DataFrame:
    """Events after each space's cursor, with next_cursor. cursors is (space, cursor), small by its number of spaces."""
    out = events.join(cursors, space).where(F.col("seq") > F.col("cursor"))
    last = out.groupBy(space).agg(F.max("seq").alias("next_cursor"))
    return out.join(last, space)


def content_addressed_store(docs: DataFrame) -> DataFrame:
    """(digest, entries, bytes): a blob for each content."""
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("entries"), F.max(F.octet_length("text")).alias("bytes"))


def union_with_provenance(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Local and shared events, repeats included, with where they are from."""
    return local.withColumn("origin", F.lit("local")).unionByName(shared.withColumn("origin", F.lit("shared")))


def usage_summary(ledger: DataFrame) -> DataFrame:
    """A row for each buyer: pulls, records served, last seen, tiers in the order they were first used."""
    per_tier = ledger.groupBy("buyer", "tier").agg(F.count("*").alias("n"), F.sum("records_served").alias("served"), F.max("ts").alias("last"), F.min("seq").alias("first"))
    tiers = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "tier"))), lambda x: x["tier"]), ",")
    return per_tier.groupBy("buyer").agg(F.sum("n").alias("pulls"), F.sum("served").alias("records_served"), F.max("last").alias("last_seen"), tiers.alias("tiers"))


def backup_reconcile(snapshots: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, status): safe, modified (no snapshot has the digest on disk), missing or unbacked.

    snapshots is (path, digest, at), disk is (path, digest).
    """
    latest = snapshots.groupBy("path").agg(F.max_by("digest", "at").alias("_digest"))
    known = snapshots.select("path", "digest").distinct().withColumn("_known", F.lit(True))
    now = disk.join(known, ["path", "digest"], "left").select("path", "digest", "_known")
    both = latest.join(now, "path", "full_outer")
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("_digest").isNull(), "unbacked").when(F.coalesce("_known", F.lit(False)), "safe").otherwise("modified")
    return both.select("path", status.alias("status"))
