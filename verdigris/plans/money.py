"""Queries of amounts, trust and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import money
from verdigris.plans.registry import query


@query("cost_rollup", "SELECT p_brand AS owner, CAST(sum(CASE WHEN p_partkey % 3 > 0 THEN (p_size + 128) * 6960 ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN (p_size + 128) * 6960 ELSE 0 END) AS BIGINT) AS scalable_total FROM <part> GROUP BY 1")
def _(t):
    return money.cost_rollup(t.part.select(F.col("p_brand").alias("owner"), F.col("p_size").alias("size"), (F.col("p_partkey") % 3 == 0).alias("scalable")))


@query("deploy_cost_plan", "WITH p AS (SELECT p_partkey AS id, p_size * 1000 + p_partkey % 1013 AS size FROM <part>), q AS (SELECT id, size, 1141440 AS program_rent, (size * 2 + 45 + 128) * 6960 AS data_rent, (size + 37 + 128) * 6960 AS buffer_rent, CAST(ceil(size / 1012) AS BIGINT) AS writes FROM p) SELECT *, (writes + 2) * 5000 AS fees, program_rent + data_rent AS locked, program_rent + data_rent + buffer_rent + (writes + 2) * 5000 AS required FROM q")
def _(t):
    return money.deploy_cost_plan(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1000 + F.col("p_partkey") % 1013).alias("size")))


SHARES = "SELECT l_orderkey AS config, CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN NULL WHEN l_linenumber = 1 THEN 4000 ELSE 3000 END AS bps, l_returnflag = 'R' AS creator FROM <lineitem>"


@query("fee_split_check", f"SELECT config, CASE WHEN NOT bool_or(creator) THEN 'fail' WHEN count(*) FILTER (bps IS NULL) > 0 THEN 'cant_tell' WHEN sum(bps) <> 10000 THEN 'fail' ELSE 'pass' END AS result FROM ({SHARES}) GROUP BY 1")
def _(t):
    bps = F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 2 == 0), None).when(F.col("l_linenumber") == 1, 4000).otherwise(3000)
    return money.fee_split_check(t.lineitem.select(F.col("l_orderkey").alias("config"), bps.alias("bps"), (F.col("l_returnflag") == "R").alias("creator")))


def spends(t):
    return t.events.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.floor("value").cast("double").alias("amount"), (F.col("event_type") != "error").alias("recipient_ok"))


@query("running_spend_cap", "WITH s AS (SELECT user_id AS session, event_id AS id, floor(value) AS amount, event_type <> 'error' AS ok, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM <events>) SELECT session, id, CAST(total AS BIGINT) AS total, concat_ws(',', CASE WHEN amount > 100 THEN 'over-each' END, CASE WHEN total > 1000 THEN 'over-session' END, CASE WHEN NOT ok THEN 'recipient' END) AS violations FROM s")
def _(t):
    return money.running_spend_cap(spends(t), 100.0, 1000.0).select("session", "id", F.col("total").cast("long").alias("total"), "violations")


@query("spend_program_allow", "WITH s AS (SELECT user_id AS session, event_id AS id, event_type AS program, floor(value) AS amount, event_type <> 'error' AS ok, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM <events>) SELECT session, id, CAST(total AS BIGINT) AS total, concat_ws(',', CASE WHEN amount > 100 THEN 'over-each' END, CASE WHEN total > 1000 THEN 'over-session' END, CASE WHEN NOT ok THEN 'recipient' END, CASE WHEN program NOT IN ('click', 'view', 'purchase') THEN 'program' END) AS violations FROM s")
def _(t):
    """Totals in ranges of a session and its time, and an allow-list of programs."""
    rows = spends(t).join(t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("program")), "id")
    return money.running_spend_cap(rows, 100.0, 1000.0, ["click", "view", "purchase"], parted=True).select("session", "id", F.col("total").cast("long").alias("total"), "violations")


@query("spend_replay")
def _(t):
    return money.spend_replay(spends(t), 100.0, 1000.0)


@query("transfer_summary", "SELECT l_orderkey AS tx, CAST(sum(CASE WHEN l_linenumber % 2 = 1 AND l_suppkey <> l_orderkey % 100 THEN CASE WHEN l_returnflag = 'N' THEN 0 ELSE floor(l_quantity) END ELSE 0 END) AS BIGINT) AS out_amount, count(DISTINCT CASE WHEN l_suppkey <> l_orderkey % 100 THEN l_suppkey END) AS recipients, bool_or(l_returnflag = 'N') AS imprecise FROM <lineitem> GROUP BY 1")
def _(t):
    payer = F.col("l_orderkey") % 100
    moves = t.lineitem.select(F.col("l_orderkey").alias("tx"), payer.alias("payer"), F.when(F.col("l_linenumber") % 2 == 1, payer).otherwise(-1).alias("source"), F.col("l_suppkey").alias("target"), F.when(F.col("l_returnflag") != "N", F.floor("l_quantity")).alias("amount"))
    return money.transfer_summary(moves)


@query("instruction_findings", "SELECT l_orderkey AS tx, max(CASE WHEN l_suppkey % 10 < 8 THEN CAST(l_suppkey % 10 * 7 + l_linenumber AS INTEGER) % 4 ELSE 1 END) AS worst, count(*) FILTER (l_suppkey % 10 >= 8) AS unknown FROM <lineitem> GROUP BY 1")
def _(t):
    calls = t.lineitem.select(F.col("l_orderkey").alias("tx"), (F.col("l_suppkey") % 10).alias("program"), F.col("l_linenumber").alias("code"))
    known = calls.where("program < 8").select("program", "code").distinct().withColumn("level", ((F.col("program") * 7 + F.col("code")) % 4).cast("int"))
    return money.instruction_findings(calls, known)


@query("batch_rank", "SELECT s_name AS id, max(CASE WHEN s_suppkey % 13 = 0 THEN -2 ELSE CASE WHEN s_suppkey % 7 = 0 THEN 1000 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE CAST(s_suppkey % 100 AS INTEGER) END END) AS rank FROM <supplier> GROUP BY 1")
def _(t):
    key = F.col("s_suppkey")
    return money.batch_rank(t.supplier.select(F.concat(F.lit(" "), "s_name").alias("id"), (key % 7 == 0).alias("impersonation"), F.when(key % 3 != 0, (key % 100).cast("int")).alias("risk"), (key % 13 == 0).alias("error")))


@query("trust_score", "WITH p AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 35 WHEN 1 THEN 30 WHEN 2 THEN 26 WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 10 END ELSE 8 END AS authority_points, CASE s_suppkey % 3 WHEN 0 THEN 25 WHEN 1 THEN 2 ELSE 8 END AS build_points, CASE WHEN s_suppkey % 4 >= 2 THEN 20 WHEN s_suppkey % 4 = 1 THEN 16 ELSE 0 END AS audit_points, CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 0 END AS curation_points, CASE s_suppkey % 7 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END AS parity_points FROM <supplier>), s AS (SELECT *, authority_points + build_points + audit_points + curation_points + parity_points AS score FROM p) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s")
def _(t):
    k = F.col("s_suppkey")
    named = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    rows = t.supplier.select(k.alias("id"), named(5, ("renounced", "dao", "multisig", "unknown", "single-key")).alias("authority"), F.when(k % 2 == 0, "x").alias("address"), named(3, ("verified", "unverified", "unknown")).alias("build"), (k % 4).alias("audits"), (k % 2 == 0).alias("curated"), named(7, ("present", "unknown", "absent", "absent", "absent", "absent", "absent")).alias("parity"))
    return money.trust_score(rows)


@query("identity_resolve", "SELECT s_suppkey AS address, concat('T', s_suppkey % 20) AS symbol, CASE WHEN s_suppkey < 10 THEN 'curated' WHEN s_suppkey < 40 THEN 'registry' ELSE 'unknown' END AS status, s_suppkey >= 10 AND s_suppkey % 20 IN (SELECT s_suppkey % 20 FROM <supplier> WHERE s_suppkey < 10) AS impersonation FROM <supplier>")
def _(t):
    tokens = t.supplier.select(F.col("s_suppkey").alias("address"), F.concat(F.lit("T"), (F.col("s_suppkey") % 20).cast("string")).alias("symbol"))
    return money.identity_resolve(tokens, tokens.where("address < 10"), tokens.where("address < 40"))


@query("authority_classify", "SELECT c_custkey AS id, CASE WHEN c_nationkey < 20 THEN concat('kind', c_nationkey % 3) ELSE 'unknown' END AS kind FROM <customer>")
def _(t):
    owners = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("owner"), F.concat(F.lit("kind"), (F.col("n_nationkey") % 3).cast("string")).alias("kind"))
    return money.authority_classify(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner")), owners)


@query("trust_resolve", "SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'directory' WHEN o_custkey % 3 = 0 AND 1000000 - o_custkey * 800 < 604800 THEN 'cache' ELSE 'unresolved' END AS source FROM <orders>")
def _(t):
    ids = t.orders.select(F.col("o_custkey").alias("id"))
    return money.trust_resolve(ids, ids.where("id % 5 = 0"), ids.where("id % 3 = 0").withColumn("at", F.col("id") * 800), 604_800, 1_000_000)


@query("secret_authority_join", "SELECT c_custkey AS pubkey, count(s_suppkey) FILTER (s_suppkey % 2 = 0) AS sole, CASE WHEN count(s_suppkey) FILTER (s_suppkey % 2 = 0) > 0 THEN 'terminal' WHEN count(s_suppkey) > 0 THEN 'rebuildable' WHEN c_acctbal > 0 THEN 'funds' ELSE 'trivial' END AS tier FROM <customer> LEFT JOIN <supplier> ON s_suppkey % 60 = c_custkey GROUP BY c_custkey, c_acctbal")
def _(t):
    programs = t.supplier.select((F.col("s_suppkey") % 60).alias("pubkey"), (F.col("s_suppkey") % 2 == 0).alias("sole"))
    return money.secret_authority_join(t.customer.select(F.col("c_custkey").alias("pubkey"), F.col("c_acctbal").alias("balance")), programs)
