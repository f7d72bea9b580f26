"""Amounts: rents, fees, shares, spending limits, transfers, trust scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import pick
from verdigris.operators.running import running

# Rent of a stored byte for two years, bytes of an account's head, payload bytes of a write, fee of a signature, heads of program accounts.
RENT_PER_BYTE, ACCOUNT_HEAD, WRITE_BYTES, SIGNATURE_FEE = 3480 * 2, 128, 1012, 5000
PROGRAM_BYTES, DATA_HEAD, BUFFER_HEAD = 36, 45, 37


def rent(size: Column) -> Column:
    """What keeps an account of so many bytes."""
    return ((size + ACCOUNT_HEAD) * RENT_PER_BYTE).cast("long")


def cost_rollup(flows: DataFrame) -> DataFrame:
    """(owner, total, scalable_total): rents of flows (owner, size, scalable); what scales with use counts apart."""
    return flows.groupBy("owner").agg(F.sum(F.when(~F.col("scalable"), rent(F.col("size"))).otherwise(0)).alias("total"), F.sum(F.when(F.col("scalable"), rent(F.col("size"))).otherwise(0)).alias("scalable_total"))


def deploy_cost_plan(programs: DataFrame) -> DataFrame:
    """programs (id, size) with rents, writes, fees, and what is locked and required."""
    writes = F.ceil(F.col("size") / WRITE_BYTES)
    out = programs.select("id", "size", rent(F.lit(PROGRAM_BYTES)).alias("program_rent"), rent(F.col("size") * 2 + DATA_HEAD).alias("data_rent"), rent(F.col("size") + BUFFER_HEAD).alias("buffer_rent"), writes.alias("writes"), ((writes + 2) * SIGNATURE_FEE).alias("fees"))
    locked = F.col("program_rent") + F.col("data_rent")
    return out.select("*", locked.alias("locked"), (locked + F.col("buffer_rent") + F.col("fees")).alias("required"))


def fee_split_check(shares: DataFrame) -> DataFrame:
    """(config, result) from (config, bps, creator): no creator fails, an unknown share can't tell, a sum but 10000 fails."""
    out = shares.groupBy("config").agg(F.bool_or("creator").alias("c"), F.count_if(F.col("bps").isNull()).alias("u"), F.sum("bps").alias("s"))
    return out.select("config", F.when(~F.col("c"), "fail").when(F.col("u") > 0, "cant_tell").when(F.col("s") != 10_000, "fail").otherwise("pass").alias("result"))


def running_spend_cap(spends: DataFrame, each: float, session: float, programs: list[str] | None = None, parted: bool = False) -> DataFrame:
    """spends (session, at, id, amount, recipient_ok) with total and the violations of each: over-each, over-session, recipient, program.

    With programs, the column program must be one of them; a null isn't. With parted
    the totals of a session come from running(), which spreads a hot one.
    """
    if parted:
        rows = running(spends, "session", ["at", "id"], "amount", "sum", "total")
    else:
        rows = spends.withColumn("total", F.sum("amount").over(W.partitionBy("session").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)))
    strange = ~F.coalesce(F.col("program").isin(programs), F.lit(False)) if programs is not None else F.lit(False)
    found = F.array(F.when(F.col("amount") > each, "over-each"), F.when(F.col("total") > session, "over-session"), F.when(~F.col("recipient_ok"), "recipient"), F.when(strange, "program"))
    return rows.withColumn("violations", F.array_join(F.array_compact(found), ","))


def spend_replay(spends: DataFrame, each: float, session: float) -> DataFrame:
    """(session, id, accepted): a refused spend doesn't count, so each decision needs those before it: a fold for each session."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        total, out = 0.0, []
        for amount, ok in zip(rows.sort_values(["at", "id"])["amount"], rows.sort_values(["at", "id"])["recipient_ok"], strict=True):
            accepted = bool(ok) and amount <= each and total + amount <= session
            total += amount if accepted else 0.0
            out.append(accepted)
        ordered = rows.sort_values(["at", "id"])
        return pd.DataFrame({"session": ordered["session"], "id": ordered["id"], "accepted": out})

    return spends.groupBy("session").applyInPandas(fold, "session long, id long, accepted boolean")


def transfer_summary(moves: DataFrame) -> DataFrame:
    """(tx, out_amount, recipients, imprecise) from (tx, payer, source, target, amount): what leaves the payer."""
    leaves = (F.col("source") == F.col("payer")) & (F.col("target") != F.col("payer"))
    return moves.groupBy("tx").agg(F.sum(F.when(leaves, F.coalesce("amount", F.lit(0))).otherwise(0)).alias("out_amount"), F.countDistinct(F.when(F.col("target") != F.col("payer"), F.col("target"))).alias("recipients"), F.bool_or(F.col("amount").isNull()).alias("imprecise"))


def instruction_findings(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(tx, worst, unknown) from calls (tx, program, code) and the severities (program, code, level) of known ones; an unknown call is a warning, 1."""
    told = calls.join(known, ["program", "code"], "left")
    return told.groupBy("tx").agg(F.max(F.coalesce("level", F.lit(1))).alias("worst"), F.count_if(F.col("level").isNull()).alias("unknown"))


def batch_rank(tokens: DataFrame) -> DataFrame:
    """(id, rank) from (id, impersonation, risk, error): impersonators first, then risk; without one -1, an error -2."""
    rank = F.when(F.col("error"), -2).otherwise(F.when(F.col("impersonation"), 1000).otherwise(0) + F.coalesce("risk", F.lit(-1)))
    return tokens.select(F.trim("id").alias("id"), rank.alias("rank")).groupBy("id").agg(F.max("rank").alias("rank"))


def trust_score(programs: DataFrame) -> DataFrame:
    """programs (id, authority, address, build, audits, curated, parity) with five factors' points, score and grade."""
    # Points of each factor.
    unknown = F.when(F.col("address").isNotNull(), 12).otherwise(10)
    authority = F.when(F.col("authority") == "unknown", unknown).otherwise(pick(F.col("authority"), {"renounced": 35, "dao": 30, "multisig": 26}, 8))
    build = pick(F.col("build"), {"verified": 25, "unverified": 2}, 8)
    audits = F.when(F.col("audits") >= 2, 20).when(F.col("audits") == 1, 16).otherwise(0)
    curation = F.when(F.col("curated"), 10).otherwise(0)
    parity = pick(F.col("parity"), {"present": 10, "unknown": 5}, 0)
    score = authority + build + audits + curation + parity
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    return programs.select("id", authority.alias("authority_points"), build.alias("build_points"), audits.alias("audit_points"), curation.alias("curation_points"), parity.alias("parity_points"), score.alias("score"), grade.alias("grade"))


def identity_resolve(tokens: DataFrame, curated: DataFrame, registry: DataFrame) -> DataFrame:
    """tokens (address, symbol) with status curated, registry or unknown, and whether they pass for a canonical symbol.

    curated and registry are (address, symbol); both are joined by size, as Spark sees it.
    """
    own = tokens.join(curated.select("address", F.lit(True).alias("_c")), "address", "left").join(registry.select("address", F.lit(True).alias("_r")), "address", "left")
    canonical = curated.select(F.upper("symbol").alias("_s")).distinct().withColumn("_known", F.lit(True))
    out = own.join(canonical, F.upper("symbol") == F.col("_s"), "left")
    status = F.when(F.col("_c"), "curated").when(F.col("_r"), "registry").otherwise("unknown")
    return out.select("address", "symbol", status.alias("status"), (F.col("_c").isNull() & F.coalesce("_known", F.lit(False))).alias("impersonation"))


def authority_classify(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """rows (id, owner) with the kind of their owner from (owner, kind), else unknown."""
    return rows.join(owners, "owner", "left").select("id", F.coalesce("kind", F.lit("unknown")).alias("kind"))


def trust_resolve(ids: DataFrame, directory: DataFrame, cache: DataFrame, ttl: int, now: int) -> DataFrame:
    """(id, source): directory, then a cache entry (id, at) younger than ttl seconds, else unresolved."""
    d = directory.select("id", F.lit("directory").alias("_d")).distinct()
    c = cache.where(F.lit(ttl > 0) & (F.lit(now) - F.col("at") < ttl)).select("id", F.lit("cache").alias("_c")).distinct()
    return ids.select("id").distinct().join(d, "id", "left").join(c, "id", "left").select("id", F.coalesce("_d", "_c", F.lit("unresolved")).alias("source"))


def secret_authority_join(secrets: DataFrame, programs: DataFrame) -> DataFrame:
    """secrets (pubkey, balance) with the number of programs (pubkey, sole) they control and a tier."""
    own = programs.groupBy("pubkey").agg(F.count_if("sole").alias("sole"), F.count("*").alias("all"))
    out = secrets.join(own, "pubkey", "left").withColumns({"sole": F.coalesce("sole", F.lit(0)), "all": F.coalesce("all", F.lit(0))})
    return out.select("pubkey", "sole", F.when(F.col("sole") > 0, "terminal").when(F.col("all") > 0, "rebuildable").when(F.col("balance") > 0, "funds").otherwise("trivial").alias("tier"))
