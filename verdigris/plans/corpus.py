"""Queries over whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.scalars import content_key
from verdigris.operators import corpus
from verdigris.plans.records import BUCKET, SCORE
from verdigris.plans.registry import query, scratch

KEY = "substr(sha256(trap_id || chr(0) || sdk_name || chr(0) || trim(regexp_replace(snippet, '\\s+', ' ', 'g'))), 1, 16)"
UNIQ = f"u AS (SELECT *, {SCORE} AS score FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY rec_no) AS rn FROM <records>) WHERE rn = 1)"
DOMAIN = "d(class, ord) AS (VALUES ('silent-zero-revenue', 0), ('immutable-after-deploy', 1), ('unchecked-staleness', 2), ('missing-slippage-guard', 3), ('auth-bypass', 4), ('unconfirmed-state', 5), ('wrong-constant', 6), ('missing-verification', 7), ('other', 8))"
BUDGET = f"""{DOMAIN}, c AS (SELECT d.class, ord, count(r.class) AS n FROM d LEFT JOIN <records> r ON r.class = d.class GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM c),
b AS (SELECT class, ord, n, total, CASE WHEN n * 4 >= total THEN 'surplus' WHEN class <> 'other' AND n * 20 < total THEN 'deficit' ELSE 'ok' END AS status,
 CAST(greatest(ceil((total - 20 * n) / 19), 0) AS BIGINT) AS need, CAST(greatest(floor((total - 4 * n) / 3), 0) AS BIGINT) AS room FROM t)"""


@query("first_seen_dedup", f"SELECT rec_no, CASE WHEN f <> rec_no THEN f END AS duplicate_of FROM (SELECT rec_no, min(rec_no) OVER (PARTITION BY {KEY}) AS f FROM <records>)")
def _(t):
    return corpus.first_seen_marks(t.records, content_key(F.col("trap_id"), F.col("sdk_name"), F.col("snippet")))


@query("first_seen_rows", f"SELECT rec_no, lot, duplicate_of FROM (SELECT rec_no, lot, CASE WHEN f <> rec_no THEN f END AS duplicate_of FROM (SELECT rec_no, lot, min(rec_no) OVER (PARTITION BY {KEY}) AS f FROM <records>))")
def _(t):
    return corpus.first_seen_dedup(corpus.scored(t.records)).select("rec_no", "lot", "duplicate_of")


@query("corpus_counts", f"SELECT count(*) AS total, count(DISTINCT {KEY}) AS unique_records, count(*) - count(DISTINCT {KEY}) AS duplicates, count(DISTINCT sdk_name) AS sdks, count(DISTINCT class) AS classes FROM <records>")
def _(t):
    return corpus.corpus_counts(t.records)


@query("distributions", f"WITH {UNIQ} SELECT 'severity' AS dim, severity AS value, count(*) AS n FROM u GROUP BY 2 UNION ALL SELECT 'class', class, count(*) FROM u GROUP BY 2 UNION ALL SELECT 'sdk_name', sdk_name, count(*) FROM u GROUP BY 2 UNION ALL SELECT 'license', license, count(*) FROM u GROUP BY 2")
def _(t):
    return corpus.distributions(t.records)


@query("quality_summary", f"WITH {UNIQ} SELECT CAST(floor(avg(score) + 0.5) AS INTEGER) AS mean_score, CAST(floor(quantile_cont(score, 0.5) + 0.5) AS INTEGER) AS median_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (score >= 70) AS high, count(*) FILTER (score BETWEEN 40 AND 69) AS medium, count(*) FILTER (score < 40) AS low FROM u")
def _(t):
    return corpus.quality_summary(t.records)


@query("coverage_matrix", f"WITH {UNIQ} SELECT class, sdk_name, count(*) AS n FROM u GROUP BY 1, 2")
def _(t):
    return corpus.coverage_matrix(t.records)


@query("thin_cells", f"WITH {UNIQ} SELECT class, sdk_name, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) = 1")
def _(t):
    return corpus.thin_cells(t.records)


@query("missing_classes", f"WITH {DOMAIN} SELECT class FROM d WHERE class <> 'other' AND class NOT IN (SELECT class FROM <records>)")
def _(t):
    return corpus.missing_classes(t.records)


@query("class_budget", f"WITH {BUDGET} SELECT * FROM b")
def _(t):
    return corpus.class_budget(t.records)


@query("class_gate", f"WITH {BUDGET}, s AS (SELECT string_agg(class, ',' ORDER BY n, ord) AS suggest FROM (SELECT * FROM b WHERE class <> 'other' ORDER BY n, ord LIMIT 3)) SELECT r.rec_no, r.class, status <> 'surplus' AS admitted, CASE WHEN status = 'surplus' THEN suggest END AS suggest FROM (SELECT rec_no, CASE WHEN rec_no % 7 = 0 THEN 'novel' ELSE class END AS class FROM <records>) r JOIN b ON b.class = CASE WHEN r.class = 'novel' THEN 'other' ELSE r.class END CROSS JOIN s")
def _(t):
    novel = F.when(F.col("rec_no") % 7 == 0, "novel").otherwise(F.col("class"))
    return corpus.class_gate(t.records.select("rec_no", novel.alias("class")), t.records)


@query("scout_work_order", f"WITH {BUDGET} SELECT CAST(row_number() OVER (ORDER BY n, need DESC, ord) AS INTEGER) AS place, class, n, need FROM b WHERE status <> 'surplus' AND class <> 'other'")
def _(t):
    return corpus.scout_work_order(t.records)


@query("thin_cell_demand_rank", f"WITH {UNIQ}, c AS (SELECT class, sdk_name FROM u GROUP BY 1, 2 HAVING count(*) = 1), x AS (SELECT class, sdk_name FROM <records> r JOIN <xp> ON event_id = rec_no) SELECT c.class, c.sdk_name, (SELECT count(*) FROM x WHERE x.class = c.class) + (SELECT count(*) FROM x WHERE x.sdk_name = c.sdk_name) AS demand FROM c")
def _(t):
    hits = t.records.join(t.xp, F.col("event_id") == F.col("rec_no"))
    demand = hits.select(F.inline(F.array(F.struct(F.lit("class").alias("kind"), F.col("class").alias("name")), F.struct(F.lit("sdk").alias("kind"), F.col("sdk_name").alias("name"))))).groupBy("kind", "name").agg(F.count("*").alias("hits"))
    return corpus.thin_cell_demand_rank(t.records, demand)


@query("catalog_summary", f"SELECT count(*) AS records, count(DISTINCT sdk_name) AS sdks, count(DISTINCT class) AS classes, CAST(floor(avg({SCORE}) + 0.5) AS INTEGER) AS mean_score, min({SCORE}) AS min_score, max({SCORE}) AS max_score, min(captured_at) AS oldest, max(captured_at) AS newest FROM <records> WHERE red AND green")
def _(t):
    return corpus.catalog_summary(t.records)


@query("hive_status", "SELECT lot, count(*) AS records, count(*) FILTER (red AND green) AS proven, count(*) FILTER (length(snippet) > 0) AS with_payload, count(*) FILTER (severity = 'critical') AS critical, max(captured_at) AS newest, count(DISTINCT sdk_name) AS sdks FROM <records> GROUP BY lot")
def _(t):
    return corpus.hive_status(t.records)


@query("sla_report", "WITH a AS (SELECT *, floor((1704067200 + 86400 * 9 - captured_at) / 86400.0) AS age, rec_no % 9 <> 0 AS can FROM <records>) SELECT lot, count(*) AS records, count(*) FILTER (length(snippet) > 0) AS valid, count(*) FILTER (can AND red AND green) AS reproduced, count(*) FILTER (NOT can) AS unverifiable, CAST(floor(quantile_cont(age, 0.5) * 2) AS BIGINT) AS twice_median_age, CAST(max(age) AS BIGINT) AS max_age, round(count(*) FILTER (can AND red AND green) / count(*) FILTER (can), 4) AS rate FROM a GROUP BY lot")
def _(t):
    return corpus.sla_report(t.records, F.col("rec_no") % 9 != 0, 1704067200 + 86400 * 9)


@query("export_manifest", f"SELECT class, CASE WHEN NOT (red AND green) THEN 'unproven' WHEN license = 'GPL-3.0' THEN 'strong-copyleft' ELSE 'kept' END AS drop_reason, count(*) AS n, bit_xor(CAST('0x' || substr({KEY}, 1, 8) AS BIGINT)) AS digest FROM <records> GROUP BY 1, 2")
def _(t):
    return corpus.export_manifest(t.records)


DIGEST = "bit_xor(CAST('0x' || substr(sha256(rec_no || '|' || trap_id || '|' || sdk_name || '|' || class || '|' || severity || '|' || snippet), 1, 8) AS BIGINT))"


@query("dataset_package", f"WITH s AS (SELECT * FROM <records> ORDER BY trap_id, rec_no LIMIT 3) SELECT 'full' AS part, 'records' AS name, count(*) AS n, {DIGEST} AS digest FROM <records> UNION ALL SELECT 'sample', 'records', count(*), {DIGEST} FROM s UNION ALL SELECT 'class', class, count(*), {DIGEST} FROM <records> GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), {DIGEST} FROM <records> GROUP BY 2 UNION ALL SELECT 'sdk_name', sdk_name, count(*), {DIGEST} FROM <records> GROUP BY 2")
def _(t):
    return corpus.dataset_package(t.records, scratch(t))
