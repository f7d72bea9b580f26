"""Queries of findings, advisories, proofs and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import reports
from verdigris.plans.records import RANK
from verdigris.plans.registry import query


@query("severity_gate", f"SELECT run_id, bool_or({RANK} >= 3 AND result IN ('fail', 'cant_tell')) AS blocked FROM <findings> GROUP BY 1")
def _(t):
    return reports.severity_gate(t.findings, "high", strict=True)


ROLL = "SELECT run_id, count(*) FILTER (result = 'fail') AS fails, count(*) FILTER (result = 'pass') AS passes, count(*) FILTER (result = 'cant_tell') AS undecided, " + ", ".join(f"count(*) FILTER (result = 'fail' AND severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + ", CASE WHEN bool_or(result = 'fail') THEN 'blocked' ELSE 'clear' END AS verdict, arg_min(rule_id, (line, rule_id, file_no)) FILTER (result = 'fail') AS top_rule FROM <findings> GROUP BY 1"


@query("report_rollup", ROLL)
def _(t):
    return reports.report_rollup(t.findings)


@query("report_consistency", f"SELECT run_id, run_id % 10 <> 0 AS consistent FROM ({ROLL})")
def _(t):
    declared = reports.report_rollup(t.findings).select("run_id", (F.col("fails") + F.when(F.col("run_id") % 10 == 0, 1).otherwise(0)).alias("fails"), "passes")
    return reports.report_consistency(declared, t.findings)


@query("top_risks", f"SELECT * FROM (SELECT DISTINCT run_id, rule_id, file_no, line, severity FROM <findings> WHERE result = 'fail') ORDER BY {RANK} DESC, run_id, rule_id, file_no, line LIMIT 8")
def _(t):
    return reports.top_risks(t.findings)


@query("preflight_verdict", "SELECT file_no, CASE WHEN bool_or(result = 'fail') THEN 'NO-GO' WHEN bool_or(result = 'cant_tell') THEN 'CAUTION' ELSE 'GO' END AS verdict FROM <snap_new> GROUP BY 1")
def _(t):
    return reports.preflight_verdict(t.snap_new, "file_no")


@query("snapshot_fix_detect", "SELECT o.rule_id, o.file_no FROM <snap_old> o JOIN <snap_new> n ON o.rule_id = n.rule_id AND o.file_no = n.file_no WHERE o.result = 'fail' AND n.result <> 'fail'")
def _(t):
    return reports.snapshot_fix_detect(t.snap_old, t.snap_new)


@query("same_rule_precedent", "WITH f AS (SELECT o.rule_id, o.file_no, o.file_no * 7 % 11 AS at FROM <snap_old> o JOIN <snap_new> n ON o.rule_id = n.rule_id AND o.file_no = n.file_no WHERE o.result = 'fail' AND n.result <> 'fail') SELECT n.rule_id, n.file_no, arg_max(f.file_no, (f.at, -f.file_no)) AS from_file FROM <snap_new> n JOIN f ON f.rule_id = n.rule_id AND f.file_no <> n.file_no WHERE n.result = 'fail' GROUP BY 1, 2")
def _(t):
    fixes = reports.snapshot_fix_detect(t.snap_old, t.snap_new).withColumn("at", F.col("file_no") * 7 % 11)
    return reports.same_rule_precedent(t.snap_new, fixes)


SCOPED = "WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey AS file_no, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS \"end\" FROM <lineitem>), r AS (SELECT DISTINCT l_suppkey AS file_no, l_partkey - l_partkey % 400 AS start, l_partkey - l_partkey % 400 + l_suppkey % 60 AS \"end\" FROM <lineitem>) SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.file_no = s.file_no AND s.start <= r.\"end\" AND s.\"end\" >= r.start)"


def sites_and_ranges(t):  # noqa: ANN001, ANN201
    low = F.col("l_partkey") - F.col("l_partkey") % 400
    sites = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("file_no"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return sites, t.lineitem.select(F.col("l_suppkey").alias("file_no"), low.alias("start"), (low + F.col("l_suppkey") % 60).alias("end")).distinct()


@query("diff_scope_join", SCOPED)
def _(t):
    return reports.diff_scope_join(*sites_and_ranges(t))


@query("diff_scope_parted", SCOPED)
def _(t):
    return reports.diff_scope_join(*sites_and_ranges(t), parted=True)


W8 = "CASE {} WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END"
ADV = "(SELECT pkg, advisory, min(sev) AS sev FROM {} GROUP BY 1, 2)"


@query("version_advisory_diff", f"SELECT coalesce(o.pkg, n.pkg) AS pkg, count(*) FILTER (o.pkg IS NULL) AS introduced, count(*) FILTER (n.pkg IS NULL) AS resolved, count(*) FILTER (o.pkg = n.pkg) AS unchanged, CAST(sum(CASE WHEN o.pkg IS NULL THEN {W8.format('n.sev')} WHEN n.pkg IS NULL THEN -{W8.format('o.sev')} ELSE 0 END) AS BIGINT) AS risk FROM {ADV.format('<adv_old>')} o FULL JOIN {ADV.format('<adv_new>')} n ON o.pkg = n.pkg AND o.advisory = n.advisory GROUP BY 1")
def _(t):
    one = lambda df: df.groupBy("pkg", "advisory").agg(F.min("sev").alias("sev"))
    return reports.version_advisory_diff(one(t.adv_old), one(t.adv_new))


@query("advisory_drift", "WITH k AS (SELECT DISTINCT pkg FROM <adv_old> WHERE pkg % 3 = 0), a AS (SELECT DISTINCT pkg, advisory FROM <adv_old> WHERE pkg IN (SELECT pkg FROM k)), b AS (SELECT DISTINCT pkg, advisory FROM <adv_new> WHERE pkg IN (SELECT pkg FROM k)) SELECT *, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'gone' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(t):
    return reports.advisory_drift(t.adv_new.where("pkg % 3 = 0"), t.adv_old, t.adv_new)


CARD = "SELECT condition, count(*) FILTER (color = 'GREEN') AS green, count(*) FILTER (color = 'RED') AS red, count(*) FILTER (color = 'UNKNOWN') AS unknown FROM <evals> GROUP BY 1"


@query("eval_scorecard", f"SELECT *, CAST(round(green * 1000.0 / (green + red)) AS BIGINT) AS per_mille FROM ({CARD})")
def _(t):
    return reports.eval_scorecard(t.evals).select("condition", "green", "red", "unknown", F.round(F.col("score") * 10).cast("long").alias("per_mille"))


@query("trap_class_rates", "WITH r AS (SELECT class_no, coalesce(avg(CASE WHEN condition = 'bare' THEN CASE WHEN color = 'RED' THEN 1.0 ELSE 0.0 END END), 0) AS a, coalesce(avg(CASE WHEN condition = 'recall' THEN CASE WHEN color = 'RED' THEN 1.0 ELSE 0.0 END END), 0) AS b FROM <evals> GROUP BY 1) SELECT class_no, round(a, 6) AS base_rate, round(b, 6) AS rate, round(a - b, 6) AS absolute, CASE WHEN a = 0 THEN 0 ELSE round((a - b) / a, 6) END AS relative FROM r")
def _(t):
    return reports.trap_class_rates(t.evals)


@query("bench_scorecard", "SELECT count(*) FILTER (color = 'GREEN' AND task_id % 4 > 0) AS avoided, count(*) AS total, CAST(round(count(*) FILTER (color = 'GREEN' AND task_id % 4 > 0) * 1000.0 / count(*)) AS BIGINT) AS per_mille FROM <evals>")
def _(t):
    submissions = t.evals.where("task_id % 4 > 0").select("task_id", (F.col("color") == "GREEN").alias("avoided"))
    return reports.bench_scorecard(t.evals, submissions).select("avoided", "total", F.round(F.col("score") * 10).cast("long").alias("per_mille"))


@query("red_green_proof", "WITH v AS (SELECT class_no, task_id % 5 AS tier, concat('m', task_id % 5) AS method, color AS before, CASE WHEN task_id % 7 < class_no THEN 'GREEN' ELSE 'UNKNOWN' END AS after FROM <evals> WHERE class_no > 0), r AS (SELECT class_no, tier, method, bool_or(before = 'RED' AND after = 'GREEN' AND tier <> class_no % 5) AS ok FROM v GROUP BY 1, 2, 3) SELECT class_no, bool_or(ok) AS proven, coalesce(string_agg(method, '+' ORDER BY tier) FILTER (ok), '') AS method FROM r GROUP BY 1")
def _(t):
    tier = F.col("task_id") % 5
    after = F.when((F.col("task_id") % 7 < F.col("class_no")) & (tier != F.col("class_no") % 5), "GREEN").otherwise("UNKNOWN")
    return reports.red_green_proof(t.evals.where("class_no > 0").select("class_no", tier.alias("tier"), F.concat(F.lit("m"), tier.cast("string")).alias("method"), F.col("color").alias("before"), after.alias("after")))


@query("ingest_verdict", "SELECT class_no, bool_or(condition = 'bare' AND color = 'RED') AND NOT bool_or(condition = 'recall' AND color = 'RED') AS accepted FROM (SELECT CASE WHEN condition = 'recall' AND color = 'RED' THEN 100 + class_no ELSE class_no END AS class_no, condition, color FROM <evals>) GROUP BY 1")
def _(t):
    moved = F.when((F.col("condition") == "recall") & (F.col("color") == "RED"), F.col("class_no") + 100).otherwise(F.col("class_no"))
    return reports.ingest_verdict(t.evals.withColumn("class_no", moved))


@query("pack_validation", "SELECT rule_id AS rule, CASE WHEN NOT bool_or(author % 5 > 0) THEN 'missing-fixtures' WHEN NOT bool_or(value > 190) THEN 'red-failed' WHEN NOT bool_or(value < 0.02) THEN 'green-failed' ELSE 'ok' END AS status FROM (SELECT concat(rule_id, repo_id) AS rule_id, author, value FROM <xp>) GROUP BY 1")
def _(t):
    rows = t.xp.select(F.concat("rule_id", F.col("repo_id").cast("string")).alias("rule"), (F.col("author") % 5 > 0).alias("has_fixtures"), (F.col("value") > 190).alias("red"), (F.col("value") < 0.02).alias("green"))
    return reports.pack_validation(rows)


@query("golden_io_diff", "WITH l AS (SELECT l_suppkey AS suite, l_orderkey * 10 + l_linenumber AS c, max(l_partkey) AS v, bool_or(l_returnflag = 'A' AND l_orderkey % 50 = 0) AS err FROM <lineitem> GROUP BY 1, 2), j AS (SELECT suite, c, err, CASE WHEN c % 997 = 0 THEN v + 1 ELSE v END <> v AND NOT err AS bad FROM l) SELECT suite, CASE WHEN bool_or(bad) THEN 'RED' WHEN bool_or(err) THEN 'UNKNOWN' ELSE 'GREEN' END AS verdict, min(c) FILTER (bad) AS first_case FROM j GROUP BY 1")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("suite"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("c")).agg(F.max("l_partkey").alias("v"), F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 50 == 0)).alias("err"))
    actual = rows.withColumn("v", F.when(F.col("c") % 997 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return reports.golden_io_diff(actual, rows, ["suite", "c"], "v", F.col("err"))


@query("check_soundness", "WITH h AS (SELECT doc_id FROM <documents> WHERE text LIKE '%$$$%' OR text LIKE '%!!%'), l AS (SELECT doc_id, quality = 0 AS bad, doc_id IN (SELECT doc_id FROM h) AS hit FROM <labels>) SELECT count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn, count(*) FILTER (NOT hit AND NOT bad) AS tn, count(*) FILTER (hit AND NOT bad) = 0 AND count(*) FILTER (hit AND bad) > 0 AS sound FROM l")
def _(t):
    hits = t.documents.where(F.contains("text", F.lit("$$$")) | F.contains("text", F.lit("!!")))
    return reports.check_soundness(hits, t.labels.select("doc_id", (F.col("quality") == 0).alias("bad")))
