"""Who may have which records: filters, tiers, grants, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import CLASSES, SEVERITIES, license_bucket, proven, quality_score, severity_rank

# Tiers with the balance they take, prices, and lots that bundles hold.
TIERS = (("sample", 0, None, None), ("standard", 100_000, 2500, 2250), ("firehose", 1_000_000, 10_000, 9_000))
LOTS = ("solana", "evm", "auth-sessions", "transport-tls", "web-hardening", "cloud-storage", "crypto", "browser-desktop", "other")
BUNDLES = {"web3": ("solana", "evm"), "appsec": ("auth-sessions", "transport-tls", "web-hardening", "cloud-storage", "crypto", "browser-desktop"), "scale": LOTS}


def proven_filter(records: DataFrame) -> DataFrame:
    """Records with both verdicts; null counts as no."""
    return records.where(proven(F.col("red"), F.col("green")))


def feed_query_filter(records: DataFrame, sdk: str | None = None, cls: str | None = None, severity: str | None = None, corroboration: int | None = None, since: int | None = None) -> DataFrame:
    """sdk is a part of the name in any case; severity and corroboration are least values; captured after since, strictly."""
    if sdk is not None:
        records = records.where(F.contains(F.lower("sdk_name"), F.lit(sdk.lower())))
    if cls is not None:
        records = records.where(F.col("class") == cls)
    if severity is not None:
        records = records.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))
    if corroboration is not None:
        records = records.where(F.coalesce("corroboration", F.lit(0)) >= corroboration)
    if since is not None:
        records = records.where(F.col("captured_at") > since)
    return records


def held_back(hours: float, now: int) -> Column:
    """Younger than so many hours; a record without a time is not."""
    return F.coalesce((F.lit(now) - F.col("captured_at")) < int(hours * 3600), F.lit(False)) if hours > 0 else F.lit(False)


def freshness_holdback(records: DataFrame, hours: float, now: int) -> DataFrame:
    return records.where(~held_back(hours, now))


def tier_masking(records: DataFrame, tier: Column) -> DataFrame:
    """Payload for the paid tiers only."""
    return records.withColumn("snippet", F.when(tier != "sample", F.col("snippet")))


def feed_select(records: DataFrame, limit: int | None = None, since: int | None = None, holdback_hours: float = 0, now: int = 0, payload: bool = True, **where: object) -> DataFrame:
    """The feed: proven records that the query takes, oldest first, at most limit.

    Ordered by time and record number. since is a time only: a limit that falls
    among records of one time leaves the rest of them out of the next pull.
    """
    found = freshness_holdback(feed_query_filter(proven_filter(records), since=since, **where), holdback_hours, now)
    out = found.select("rec_no", "trap_id", "sdk_name", "sdk_version", "class", "severity", "corroboration", "captured_at", "license", quality_score(F.col("severity"), F.col("corroboration"), F.lit(True)).alias("score"), (F.col("snippet") if payload else F.lit(None).cast("string")).alias("snippet"))
    out = out.orderBy("captured_at", "rec_no")
    return out.limit(limit) if limit is not None else out


def feed_counts(records: DataFrame, limit: int | None, since: int | None, holdback_hours: float, now: int, **where: object) -> DataFrame:
    """One row: matched, held back, emitted, capped, and the cursor after the pull."""
    found = feed_query_filter(proven_filter(records), since=since, **where).withColumn("held", held_back(holdback_hours, now))
    counts = found.agg(F.count("*").alias("matched"), F.count_if("held").alias("held_back"))
    taken = found.where("NOT held").select("captured_at", "rec_no").orderBy("captured_at", "rec_no")
    taken = taken.limit(limit) if limit is not None else taken
    last = taken.agg(F.count("*").alias("emitted"), F.max("captured_at").alias("cursor"))
    return counts.join(F.broadcast(last), F.lit(True)).select("matched", "held_back", "emitted", (F.col("matched") - F.col("held_back") - F.col("emitted")).alias("capped"), F.coalesce("cursor", F.lit(since)).cast("long").alias("cursor"))


def tier_of(balance: Column) -> Column:
    """The highest tier that a balance reaches; negative and not finite ones count as 0."""
    out = F.lit("sample")
    for name, least, *_ in TIERS[1:]:
        out = F.when(balance >= least, name).otherwise(out)
    return F.when(F.isnan(balance) | (F.abs(balance) == float("inf")), "sample").otherwise(out)


def access_quote(buyers: DataFrame, balance: Column) -> DataFrame:
    """buyers with tier, price_usd, next_tier and short_by."""
    held = F.greatest(F.coalesce(F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance), F.lit(0.0)), F.lit(0.0))
    tier = tier_of(held)
    names = [t[0] for t in TIERS]
    after = F.when(tier == names[0], names[1]).when(tier == names[1], names[2])
    least = F.when(tier == names[0], TIERS[1][1]).when(tier == names[1], TIERS[2][1])
    price = F.when(tier == names[1], TIERS[1][2]).when(tier == names[2], TIERS[2][2])
    return buyers.select("*", tier.alias("tier"), price.alias("price_usd"), after.alias("next_tier"), F.when(least.isNotNull(), F.greatest(least - held, F.lit(0.0))).alias("short_by"))


def expand_lots(lots: list[str], bundles: list[str]) -> list[str]:
    """Lots and those of bundles, each once; an unknown bundle is an error."""
    unknown = [b for b in bundles if b.lower() not in BUNDLES]
    if unknown:
        raise ValueError(f"unknown bundle {unknown[0]!r}; there are {', '.join(BUNDLES)}")
    return list(dict.fromkeys([*lots, *(lot for b in bundles for lot in BUNDLES[b.lower()])]))


def lot_scope_filter(records: DataFrame, grants: DataFrame) -> DataFrame:
    """(buyer, record columns) for grants (buyer, lots array): an empty scope is all lots.

    Records meet scoped buyers by lot. Buyers of all lots have the same records:
    these come once, with a null buyer, if there is such a grant, and not once a buyer.
    """
    one = grants.select("buyer", F.explode(F.array_distinct("lots")).alias("lot"))
    scoped = records.join(one, "lot").select("buyer", *records.columns)
    every = grants.where(F.size("lots") == 0).limit(1).select(F.lit(None).cast(grants.schema["buyer"].dataType).alias("buyer"))
    return scoped.unionByName(records.join(F.broadcast(every), F.lit(True)).select("buyer", *records.columns))


def grant_validity(grants: DataFrame, now: int, schemes: tuple[str, ...] = ("hmac-sha256",), signers: tuple[str, ...] = ("operator",)) -> DataFrame:
    """grants with reason: malformed, bad-scheme, untrusted-signer, expired or ok, the first that holds."""
    bad = F.col("buyer").isNull() | F.col("tier").isNull() | ~F.col("tier").isin(*(t[0] for t in TIERS))
    reason = F.when(bad, "malformed").when(~F.col("alg").isin(*schemes), "bad-scheme").when(~F.col("signer").isin(*signers), "untrusted-signer").when(F.col("expires_at") <= now, "expired").otherwise("ok")
    return grants.withColumn("reason", reason)


def schema_validity(records: DataFrame) -> DataFrame:
    """records with valid: required fields are there and enumerations hold."""
    text = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    ok = text("trap_id") & text("sdk_name") & text("snippet") & F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)) & F.coalesce(F.col("class").isin(*CLASSES), F.lit(False)) & F.col("captured_at").isNotNull()
    return records.withColumn("valid", ok)


def submission_reasons(title: Column, severity: Column, body: Column, safe_id: Column, most_bytes: int = 64 * 1024) -> Column:
    """Why a submission is refused; empty when it is sound."""
    checks = (
        (~F.coalesce(safe_id.rlike("^[a-z0-9][a-z0-9._-]*$"), F.lit(False)), "id"),
        (~F.coalesce(severity.isin(*SEVERITIES), F.lit(False)), "severity"),
        (F.coalesce(F.length(F.trim(title)), F.lit(0)) == 0, "title"),
        (F.coalesce(F.length(F.trim(body)), F.lit(0)) == 0, "body"),
        (F.coalesce(F.octet_length(body), F.lit(0)) > most_bytes, "too-large"),
    )
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)), lambda x: x.isNotNull())


def consent_filter(records: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    return records.where(F.col("lot").isin(*scopes))


def copyleft_exclusion(records: DataFrame) -> DataFrame:
    """records with bucket and drop_reason: strong copyleft goes, none and unknown stay."""
    bucketed = records.withColumn("bucket", license_bucket(F.col("license")))
    return bucketed.withColumn("drop_reason", F.when(F.col("bucket") == "strong-copyleft", "strong-copyleft"))


def license_join(records: DataFrame, licenses: DataFrame) -> DataFrame:
    """records with the licence of their repository (source_repo, repo_license), its bucket, and whether it is safe to sell."""
    found = records.join(licenses, "source_repo", "left")
    bucket = license_bucket(F.coalesce("repo_license", F.lit("unknown")))
    return found.select("rec_no", "source_repo", F.coalesce("repo_license", F.lit("unknown")).alias("repo_license"), bucket.alias("bucket"), (bucket == "permissive").alias("commercial_safe"))


def running_total(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def recall_select(lots: list[DataFrame], **where: object) -> DataFrame:
    """Several lots as one feed with payload: the richest copy of each record first."""
    from verdigris.operators.merges import richest_copy

    every = lots[0]
    for lot in lots[1:]:
        every = every.unionByName(lot)
    return feed_select(richest_copy(every), **where)


def feed_to_record(feed: DataFrame) -> DataFrame:
    """Records from rows of a feed: what a feed emits is proven."""
    return feed.select("rec_no", "trap_id", "sdk_name", "sdk_version", "class", "severity", "corroboration", F.lit(True).alias("red"), F.lit(True).alias("green"), "captured_at", "license", "snippet")
