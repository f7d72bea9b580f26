"""Queries on records: filters, tiers, grants, the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import scalars as S
from verdigris.operators import access
from verdigris.plans.registry import query

NOW = 1704067200 + 60 * 5000
SCORE = "CASE WHEN red AND green THEN CAST(floor((CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 ELSE 3 END * (30 + 4 * least(corroboration, 5)) * 2 + 5) / 10) AS INTEGER) ELSE 0 END"
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
BUCKET = "CASE WHEN license IN ('MIT', 'APACHE-2.0') THEN 'permissive' WHEN license = 'GPL-3.0' THEN 'strong-copyleft' ELSE 'none' END"


@query("proven_filter", "SELECT rec_no, trap_id, severity FROM <records> WHERE red AND green")
def _(t):
    return access.proven_filter(t.records).select("rec_no", "trap_id", "severity")


@query("feed_query_filter", f"SELECT rec_no FROM <records> WHERE lower(sdk_name) LIKE '%dk-1%' AND class = 'auth-bypass' AND {RANK} >= 3 AND corroboration >= 1 AND captured_at > 1704067200 + 600")
def _(t):
    return access.feed_query_filter(t.records, sdk="DK-1", cls="auth-bypass", severity="high", corroboration=1, since=1704067200 + 600).select("rec_no")


@query("freshness_holdback", f"SELECT rec_no FROM <records> WHERE {NOW} - captured_at >= 75 * 3600")
def _(t):
    return access.freshness_holdback(t.records, 75, NOW).select("rec_no")


@query("tier_masking", "SELECT rec_no, CASE rec_no % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'standard' ELSE 'firehose' END AS tier, CASE WHEN rec_no % 3 <> 0 THEN sha256(snippet) END AS payload_sha FROM <records>")
def _(t):
    tier = F.when(F.col("rec_no") % 3 == 0, "sample").when(F.col("rec_no") % 3 == 1, "standard").otherwise("firehose")
    return access.tier_masking(t.records.withColumn("tier", tier), F.col("tier")).select("rec_no", "tier", F.sha2("snippet", 256).alias("payload_sha"))


@query("feed_select", f"SELECT rec_no, trap_id, severity, captured_at, {SCORE} AS score FROM <records> WHERE red AND green AND {RANK} >= 2 AND {NOW} - captured_at >= 24 * 3600 ORDER BY captured_at, rec_no LIMIT 500")
def _(t):
    return access.feed_select(t.records, limit=500, holdback_hours=24, now=NOW, severity="medium").select("rec_no", "trap_id", "severity", "captured_at", "score")


@query(
    "feed_counts",
    f"""WITH m AS (SELECT captured_at, rec_no, {NOW} - captured_at < 72 * 3600 AS held FROM <records> WHERE red AND green AND captured_at > 1704067200 + 60),
e AS (SELECT * FROM m WHERE NOT held ORDER BY captured_at, rec_no LIMIT 100)
SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM m WHERE held) AS held_back, (SELECT count(*) FROM e) AS emitted,
 (SELECT count(*) FROM m WHERE NOT held) - (SELECT count(*) FROM e) AS capped, coalesce((SELECT max(captured_at) FROM e), 1704067200 + 60) AS "cursor" """,
)
def _(t):
    return access.feed_counts(t.records, 100, 1704067200 + 60, 72, NOW)


TIER_SQL = "CASE WHEN b >= 1000000 THEN 'firehose' WHEN b >= 100000 THEN 'standard' ELSE 'sample' END"


@query("tier_for_balance", f"SELECT c_custkey, {TIER_SQL} AS tier FROM (SELECT c_custkey, c_acctbal * 150 AS b FROM <customer>)")
def _(t):
    return t.customer.select("c_custkey", access.tier_of(F.col("c_acctbal") * 150).alias("tier"))


@query(
    "access_quote",
    f"""SELECT c_custkey, {TIER_SQL} AS tier, CASE {TIER_SQL} WHEN 'standard' THEN 2500 WHEN 'firehose' THEN 10000 END AS price_usd,
 CASE {TIER_SQL} WHEN 'sample' THEN 'standard' WHEN 'standard' THEN 'firehose' END AS next_tier,
 CAST(round(CASE {TIER_SQL} WHEN 'sample' THEN 100000 - greatest(b, 0) WHEN 'standard' THEN 1000000 - b END) AS BIGINT) AS short_by
FROM (SELECT c_custkey, c_acctbal * 150 AS b FROM <customer>)""",
)
def _(t):
    return access.access_quote(t.customer, F.col("c_acctbal") * 150).select("c_custkey", "tier", "price_usd", "next_tier", F.round("short_by").cast("long").alias("short_by"))


@query("lot_scope_filter", "WITH r AS (SELECT rec_no, concat(source_repo, '/', rec_no % 500) AS lot FROM <records>), g AS (SELECT c_custkey AS buyer, unnest(list_distinct([concat('src', c_custkey % 20, '/', c_custkey % 500), concat('src', c_custkey % 19, '/', c_custkey % 499)])) AS lot FROM <customer> WHERE c_custkey % 50 > 0) SELECT buyer, rec_no FROM r JOIN g ON g.lot = r.lot UNION ALL SELECT NULL, rec_no FROM r")
def _(t):
    k = F.col("c_custkey")
    name = lambda a, b: F.concat(F.lit("src"), (k % a).cast("string"), F.lit("/"), (k % b).cast("string"))
    lots = F.when(k % 50 > 0, F.array(name(20, 500), name(19, 499))).otherwise(F.array().cast("array<string>"))
    records = t.records.withColumn("lot", F.concat("source_repo", F.lit("/"), (F.col("rec_no") % 500).cast("string")))
    return access.lot_scope_filter(records, t.customer.select(k.alias("buyer"), lots.alias("lots"))).select("buyer", "rec_no")


@query(
    "grant_validity",
    """SELECT buyer, CASE WHEN tier NOT IN ('sample', 'standard', 'firehose') THEN 'malformed' WHEN buyer % 11 = 0 THEN 'bad-scheme'
 WHEN buyer % 7 = 0 THEN 'untrusted-signer' WHEN epoch(ts) + 86400 * 365 <= 946684800 THEN 'expired' ELSE 'ok' END AS reason, count(*) AS n FROM <ledger> GROUP BY 1, 2""",
)
def _(t):
    grants = t.ledger.select("buyer", "tier", F.when(F.col("buyer") % 11 == 0, "none").otherwise("hmac-sha256").alias("alg"), F.when(F.col("buyer") % 7 == 0, "stranger").otherwise("operator").alias("signer"), (F.unix_timestamp("ts") + 86400 * 365).alias("expires_at"))
    return access.grant_validity(grants, 946684800).groupBy("buyer", "reason").agg(F.count("*").alias("n"))


@query("schema_validity", "SELECT rec_no, length(snippet) > 0 AS valid FROM <records>")
def _(t):
    return access.schema_validity(t.records).select("rec_no", "valid")


@query(
    "submission_validate",
    """SELECT doc_id, concat_ws(',', CASE WHEN lower(source) || '/' || lang LIKE '%/de' THEN 'id' END, CASE WHEN doc_id % 9 = 0 THEN 'severity' END,
 CASE WHEN length(trim(lang)) = 0 THEN 'title' END, CASE WHEN length(trim(text)) = 0 THEN 'body' END, CASE WHEN strlen(text) > 8192 THEN 'too-large' END) AS reasons FROM <documents>""",
)
def _(t):
    safe = F.when(F.col("lang") == "de", F.concat_ws("/", "source", "lang")).otherwise(F.lower("source"))
    severity = F.when(F.col("doc_id") % 9 == 0, "grave").otherwise("high")
    return t.documents.select("doc_id", F.array_join(access.submission_reasons(F.col("lang"), severity, F.col("text"), safe, 8192), ",").alias("reasons"))


@query("consent_filter", "SELECT rec_no FROM <records> WHERE lot IN ('contrib')")
def _(t):
    return access.consent_filter(t.records, ("contrib",)).select("rec_no")


@query("severity_from_score", """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber % 5 = 0 THEN 'medium' WHEN l_linenumber % 5 = 1 THEN 'high'
 WHEN floor(l_quantity) / 5.0 >= 9 THEN 'critical' WHEN floor(l_quantity) / 5.0 >= 7 THEN 'high' WHEN floor(l_quantity) / 5.0 >= 4 THEN 'medium' ELSE 'low' END AS severity FROM <lineitem>""")
def _(t):
    value = F.when(F.col("l_linenumber") % 5 == 0, "MODERATE").when(F.col("l_linenumber") % 5 == 1, "CVSS:3.1/AV:N").otherwise((F.floor("l_quantity") / 5.0).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", S.severity_from_score(value).alias("severity"))


@query("license_join", f"SELECT r.rec_no, source_repo, coalesce(l.license, 'unknown') AS repo_license, CASE WHEN l.license IS NULL THEN 'unknown' ELSE {BUCKET.replace('license', 'l.license')} END AS bucket, coalesce(l.license IN ('MIT', 'APACHE-2.0'), false) AS commercial_safe FROM <records> r LEFT JOIN (SELECT source_repo, max(license) AS license FROM <records> WHERE rec_no % 3 = 0 AND source_repo <> 'src3' GROUP BY 1) l USING (source_repo)")
def _(t):
    licenses = t.records.where("rec_no % 3 = 0 AND source_repo <> 'src3'").groupBy("source_repo").agg(F.max("license").alias("repo_license"))
    return access.license_join(t.records, licenses)


@query("copyleft_exclusion", f"SELECT rec_no, {BUCKET} AS bucket, CASE WHEN license = 'GPL-3.0' THEN 'strong-copyleft' END AS drop_reason FROM <records>")
def _(t):
    return access.copyleft_exclusion(t.records).select("rec_no", "bucket", "drop_reason")


@query("teaser_projection", "SELECT rec_no, trap_id, sdk_name, class, severity, red AND green AS proven FROM <records>")
def _(t):
    return t.records.select("rec_no", "trap_id", "sdk_name", "class", "severity", S.proven(F.col("red"), F.col("green")).alias("proven"))


@query("quality_score", f"SELECT rec_no, {SCORE} AS score FROM <records>")
def _(t):
    return t.records.select("rec_no", S.quality_score(F.col("severity"), F.col("corroboration"), S.proven(F.col("red"), F.col("green"))).alias("score"))


@query("content_key", "SELECT rec_no, substr(sha256(trap_id || chr(0) || sdk_name || chr(0) || trim(regexp_replace(snippet, '\\s+', ' ', 'g'))), 1, 16) AS content_key FROM <records>")
def _(t):
    return t.records.select("rec_no", S.content_key(F.col("trap_id"), F.col("sdk_name"), F.col("snippet")).alias("content_key"))


@query("snippet_trim", "SELECT rec_no, sha256(CASE WHEN length(x) > 120 THEN substr(x, 1, 120) || chr(10) || '…' ELSE x END) AS sha FROM (SELECT rec_no, nullif(regexp_replace(snippet, '^\\s+|\\s+$', '', 'g'), '') AS x FROM <records>)")
def _(t):
    return t.records.select("rec_no", F.sha2(S.snippet_trim(F.col("snippet"), 120), 256).alias("sha"))


RICHEST = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY trap_id, sdk_name, sdk_version ORDER BY length(snippet) > 0 DESC, corroboration DESC, rec_no) AS rn FROM <records>) WHERE rn = 1)"


@query("recall_select", f"SELECT rec_no, captured_at, {SCORE} AS score FROM {RICHEST} WHERE red AND green ORDER BY captured_at, rec_no LIMIT 300")
def _(t):
    lots = [t.records.where(F.col("lot") == lot) for lot in ("seed", "contrib")]
    return access.recall_select(lots, limit=300).select("rec_no", "captured_at", "score")


@query("feed_to_record", "SELECT rec_no, trap_id, red, green, captured_at, sha256(snippet) AS sha FROM <records> WHERE red AND green")
def _(t):
    return access.feed_to_record(access.feed_select(t.records)).select("rec_no", "trap_id", "red", "green", "captured_at", F.sha2("snippet", 256).alias("sha"))


PATTERN = "CASE WHEN ends_with(lower(r), 'algorithm-none') THEN 'algorithm-none' WHEN ends_with(lower(r), 'cookie-secure-false') THEN 'cookie-secure-false' ELSE r END"


@query("record_names", f"WITH n AS (SELECT rec_no, concat('MyTrap', rec_no, 'Of ', sdk_name, '-', upper(sdk_version), 'b') AS x, concat(trap_id, CASE rec_no % 3 WHEN 0 THEN '-Algorithm-None' WHEN 1 THEN '-cookie-secure-FALSE' ELSE '' END) AS r FROM <records>) SELECT rec_no, lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS snake, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, {PATTERN} AS pattern FROM n")
def _(t):
    x = F.concat(F.lit("MyTrap"), F.col("rec_no").cast("string"), F.lit("Of "), "sdk_name", F.lit("-"), F.upper("sdk_version"), F.lit("b"))
    rule = F.concat("trap_id", F.when(F.col("rec_no") % 3 == 0, "-Algorithm-None").when(F.col("rec_no") % 3 == 1, "-cookie-secure-FALSE").otherwise(""))
    return t.records.select("rec_no", S.snake_case(x).alias("snake"), S.slug(x).alias("slug"), S.rule_pattern(rule).alias("pattern"))


USD = "CASE WHEN v IS NULL THEN '—' WHEN v >= 1e9 THEN printf('$%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('$%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('$%.0fK', v / 1e3) ELSE concat('$', CAST(round(v) AS BIGINT)) END"
AGO = "CASE WHEN then_s IS NULL THEN 'never' WHEN then_s > 1000000000 THEN NULL WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 2880 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END"


@query("order_texts", f"WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey * 7919 % 9973 + 0.37) * power(10, o_orderkey % 7) END AS v, CASE WHEN o_orderkey % 13 > 0 THEN 1000000000 - o_custkey * power(7, o_orderkey % 5) + 60 END::BIGINT AS then_s, o_orderkey * 1234567 AS lamports FROM <orders>), w AS (SELECT *, CAST(floor((1000000000 - then_s) / 60.0) AS BIGINT) AS m FROM v) SELECT o_orderkey, {USD} AS usd, {AGO} AS ago, regexp_replace(regexp_replace(CAST(CAST(lamports AS DECIMAL(28, 9)) * CAST(0.000000001 AS DECIMAL(10, 9)) AS VARCHAR), '0+$', ''), '\\.$', '') AS sol, to_timestamp(then_s + 86400 * 30)::DATE::VARCHAR AS due FROM w")
def _(t):
    k = F.col("o_orderkey")
    value = F.when(k % 11 > 0, (k * 7919 % 9973 + F.lit(0.37)) * F.pow(F.lit(10.0), k % 7))
    then = F.when(k % 13 > 0, (1_000_000_000 - F.col("o_custkey") * F.pow(F.lit(7.0), k % 5) + 60).cast("long"))
    due = F.to_date(F.timestamp_seconds(S.add_days(then, 30))).cast("string")
    return t.orders.select("o_orderkey", S.usd_text(value).alias("usd"), S.age_text(then, 1_000_000_000).alias("ago"), S.lamports_text(k * 1_234_567).alias("sol"), due.alias("due"))


@query("invoked_programs", "WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'noise' ELSE concat('Program ', role, ' invoke [', turn, ']') END AS line, turn % 3 < 2 AS ok, role FROM <conversations>) SELECT conv_id, array_to_string(list_sort(list(DISTINCT role) FILTER (ok)), ',') AS programs FROM l GROUP BY 1")
def _(t):
    line = F.when(F.col("turn") % 3 == 2, "noise").otherwise(F.concat(F.lit("Program "), "role", F.lit(" invoke ["), F.col("turn").cast("string"), F.lit("]")))
    logs = t.conversations.groupBy("conv_id").agg(F.collect_list(line).alias("logs"))
    return logs.select("conv_id", F.array_join(F.array_sort(S.invoked_programs(F.col("logs"))), ",").alias("programs"))


@query("canonical_json", "SELECT event_id, '{\"a\":\"' || event_type || '\",\"m\":' || replace(replace(props, ' ', ''), ': ', ':') || ',\"z\":[' || user_id || ',{\"x\":null,\"y\":\"\\n\"}]}' AS text FROM <events>")
def _(t):
    """JSON that is written with blanks and keys in another order."""
    text = F.concat(F.lit('{ "z": ['), F.col("user_id").cast("string"), F.lit(', {"y": "\\u000a", "x": null}],\n "m": '), "props", F.lit(', "a": "'), "event_type", F.lit('" }'))
    return t.events.select("event_id", S.canonical_json(text).alias("text"))
