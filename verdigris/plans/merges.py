"""Queries of merges and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import merges
from verdigris.plans.registry import query

RICH = "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY trap_id, sdk_name, sdk_version ORDER BY length(snippet) > 0 DESC, corroboration DESC, rec_no) AS rn FROM {}) WHERE rn = 1"


@query("richest_copy", f"SELECT trap_id, sdk_name, sdk_version, rec_no, corroboration FROM ({RICH.format('<records>')})")
def _(t):
    return merges.richest_copy(t.records).select("trap_id", "sdk_name", "sdk_version", "rec_no", "corroboration")


@query(
    "upsert_merge",
    f"""WITH h AS ({RICH.format("(SELECT * FROM <records> WHERE rec_no % 2 = 0)")}), n AS ({RICH.format("(SELECT * FROM <records> WHERE rec_no % 2 = 1)")})
SELECT coalesce(h.trap_id, n.trap_id) AS trap_id, coalesce(h.sdk_name, n.sdk_name) AS sdk_name, coalesce(h.sdk_version, n.sdk_version) AS sdk_version,
 CASE WHEN h.rec_no IS NULL THEN n.corroboration WHEN n.rec_no IS NULL THEN h.corroboration ELSE greatest(h.corroboration, n.corroboration) END AS corroboration,
 sha256(CASE WHEN h.rec_no IS NULL OR n.corroboration > h.corroboration THEN n.snippet ELSE h.snippet END) AS sha,
 CASE WHEN h.rec_no IS NULL THEN 'added' WHEN n.corroboration > h.corroboration THEN 'updated' WHEN n.rec_no IS NOT NULL THEN 'unchanged' ELSE 'kept' END AS outcome
FROM h FULL JOIN n ON h.trap_id = n.trap_id AND h.sdk_name = n.sdk_name AND h.sdk_version = n.sdk_version""",
)
def _(t):
    held, new = (merges.richest_copy(t.records.where(f"rec_no % 2 = {i}")) for i in (0, 1))
    return merges.upsert_merge(held, new).select("trap_id", "sdk_name", "sdk_version", "corroboration", F.sha2("snippet", 256).alias("sha"), "outcome")


@query("insert_if_absent", "SELECT rec_no, trap_id FROM <records> WHERE rec_no % 20 > 0 AND trap_id NOT IN (SELECT trap_id FROM <records> WHERE rec_no % 20 = 0)")
def _(t):
    return merges.insert_if_absent(t.records.where("rec_no % 20 = 0"), t.records.where("rec_no % 20 > 0")).select("rec_no", "trap_id")


KEY = "author, rule_id, repo_id, file_no"


@query("event_idempotent_append", f"SELECT event_id, {KEY} FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY event_id) AS rn FROM <xp> WHERE event_id % 3 > 0) WHERE rn = 1 AND ({KEY}) NOT IN (SELECT ({KEY}) FROM <xp> WHERE event_id % 3 = 0)")
def _(t):
    key = KEY.split(", ")
    return merges.event_idempotent_append(t.xp.where("event_id % 3 = 0"), t.xp.where("event_id % 3 > 0"), key).select("event_id", *key)


@query("last_write_upsert", "SELECT repo_id, arg_max(event_id, (fixed_at, event_id)) AS event_id, max(fixed_at) AS fixed_at FROM <xp> GROUP BY repo_id")
def _(t):
    return merges.last_write_upsert(t.xp, "repo_id", ["fixed_at", "event_id"]).select("repo_id", "event_id", "fixed_at")


@query("packaging_sync", "WITH a AS (SELECT DISTINCT trap_id, sdk_name FROM <records> WHERE rec_no % 2 = 0), b AS (SELECT DISTINCT trap_id, sdk_name FROM <records> WHERE rec_no % 2 = 1), x AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b) SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS in_sync FROM x")
def _(t):
    return merges.packaging_sync(t.records.where("rec_no % 2 = 0"), t.records.where("rec_no % 2 = 1"), ["trap_id", "sdk_name"])


@query("rule_precedence", "WITH r AS (SELECT DISTINCT rule_id, file_no % 4 AS source_rank FROM <findings>) SELECT rule_id, source_rank, source_rank > min(source_rank) OVER (PARTITION BY rule_id) AS shadowed FROM r")
def _(t):
    return merges.rule_precedence(t.findings.select("rule_id", (F.col("file_no") % 4).alias("source_rank")).distinct())


@query(
    "seq_assign",
    f"""WITH h AS (SELECT repo_id, {KEY.replace(', repo_id', '')}, row_number() OVER (PARTITION BY repo_id ORDER BY event_id) AS seq FROM <xp> WHERE event_id % 5 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY event_id) AS rn FROM <xp> WHERE event_id % 5 > 0) WHERE rn = 1 AND ({KEY}) NOT IN (SELECT ({KEY}) FROM h))
SELECT event_id, f.repo_id, coalesce(m, 0) + row_number() OVER (PARTITION BY f.repo_id ORDER BY fixed_at, event_id) AS seq
FROM f LEFT JOIN (SELECT repo_id, max(seq) AS m FROM h GROUP BY 1) l ON l.repo_id = f.repo_id""",
)
def _(t):
    from pyspark.sql import Window as W

    held = t.xp.where("event_id % 5 = 0").withColumn("seq", F.row_number().over(W.partitionBy("repo_id").orderBy("event_id")))
    return merges.seq_assign(held, t.xp.where("event_id % 5 > 0"), "repo_id", ["author", "rule_id", "file_no"], ["fixed_at", "event_id"]).select("event_id", "repo_id", "seq")


@query("seq_delta_read", "WITH s AS (SELECT event_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY event_id) AS seq FROM <xp>) SELECT event_id, repo_id, seq, max(seq) OVER (PARTITION BY repo_id) AS next_cursor FROM s WHERE seq > repo_id * 10")
def _(t):
    from pyspark.sql import Window as W

    events = t.xp.select("event_id", "repo_id", F.row_number().over(W.partitionBy("repo_id").orderBy("event_id")).cast("long").alias("seq"))
    cursors = t.xp.select("repo_id", (F.col("repo_id") * 10).alias("cursor")).distinct()
    return merges.seq_delta_read(events, "repo_id", cursors).select("event_id", "repo_id", "seq", "next_cursor")


@query("content_addressed_store", "SELECT sha256(text) AS digest, count(*) AS entries, CAST(max(strlen(text)) AS INTEGER) AS bytes FROM <documents> GROUP BY 1")
def _(t):
    return merges.content_addressed_store(t.documents)


@query("union_with_provenance", "SELECT origin, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT 'local' AS origin, event_id FROM <xp> WHERE author < 75 UNION ALL SELECT 'shared', event_id FROM <xp> WHERE author % 2 = 0) GROUP BY 1")
def _(t):
    return merges.union_with_provenance(t.xp.where("author < 75"), t.xp.where("author % 2 = 0")).groupBy("origin").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("usage_summary", "WITH p AS (SELECT buyer, tier, count(*) AS n, sum(records_served) AS s, max(ts) AS l, min(seq) AS f FROM <ledger> GROUP BY 1, 2) SELECT buyer, CAST(sum(n) AS BIGINT) AS pulls, CAST(sum(s) AS BIGINT) AS records_served, max(l) AS last_seen, string_agg(tier, ',' ORDER BY f) AS tiers FROM p GROUP BY 1")
def _(t):
    return merges.usage_summary(t.ledger)


@query(
    "backup_reconcile",
    """WITH s AS (SELECT concat(rule_id, '/', file_no) AS path, result AS digest, 1 AS at FROM <snap_old> UNION ALL SELECT concat(rule_id, '/', file_no), result, 2 FROM <snap_new> WHERE file_no % 2 = 0),
d AS (SELECT concat(rule_id, '/', file_no) AS path, CASE WHEN file_no % 5 = 0 THEN 'new' ELSE result END AS digest FROM <snap_new>),
l AS (SELECT DISTINCT path FROM s)
SELECT coalesce(l.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'unbacked' WHEN EXISTS (SELECT 1 FROM s WHERE s.path = d.path AND s.digest = d.digest) THEN 'safe' ELSE 'modified' END AS status
FROM l FULL JOIN d ON d.path = l.path""",
)
def _(t):
    path = F.concat(F.col("rule_id").cast("string"), F.lit("/"), F.col("file_no").cast("string")).alias("path")
    snapshots = t.snap_old.select(path, F.col("result").alias("digest"), F.lit(1).alias("at")).unionByName(t.snap_new.where("file_no % 2 = 0").select(path, F.col("result").alias("digest"), F.lit(2).alias("at")))
    disk = t.snap_new.select(path, F.when(F.col("file_no") % 5 == 0, "new").otherwise(F.col("result")).alias("digest"))
    return merges.backup_reconcile(snapshots, disk)
