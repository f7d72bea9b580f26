"""Findings, snapshots, advisories, proofs and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import severity_rank
from verdigris.operators.running import running


def severity_gate(findings: DataFrame, least: str = "high", strict: bool = False) -> DataFrame:
    """(run_id, blocked): a finding of at least a severity fails; strict counts undecided ones too."""
    grave = severity_rank(F.col("severity")) >= severity_rank(F.lit(least))
    bad = (F.col("result") == "fail") | (F.lit(strict) & (F.col("result") == "cant_tell"))
    return findings.groupBy("run_id").agg(F.bool_or(grave & bad).alias("blocked"))


def report_rollup(findings: DataFrame) -> DataFrame:
    """A row for each run: counts by result, failures by severity, verdict, and the first failure's rule."""
    fail = F.col("result") == "fail"
    first = F.min(F.when(fail, F.struct("line", "rule_id", "file_no"))).alias("_first")
    by = [F.count_if(fail & (F.col("severity") == s)).alias(s) for s in ("critical", "high", "medium", "low")]
    out = findings.groupBy("run_id").agg(F.count_if(fail).alias("fails"), F.count_if(F.col("result") == "pass").alias("passes"), F.count_if(F.col("result") == "cant_tell").alias("undecided"), *by, first)
    return out.select("*", F.when(F.col("fails") > 0, "blocked").otherwise("clear").alias("verdict"), F.col("_first.rule_id").alias("top_rule")).drop("_first")


def report_consistency(declared: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, consistent): declared fails and passes are those of the findings."""
    real = report_rollup(findings).select("run_id", F.col("fails").alias("_f"), F.col("passes").alias("_p"))
    return declared.join(real, "run_id", "left").select("run_id", (F.col("fails").eqNullSafe(F.coalesce("_f", F.lit(0))) & F.col("passes").eqNullSafe(F.coalesce("_p", F.lit(0)))).alias("consistent"))


def top_risks(findings: DataFrame, top: int = 8) -> DataFrame:
    """The gravest failures."""
    rows = findings.where("result = 'fail'").select("run_id", "rule_id", "file_no", "line", "severity").distinct()
    return rows.orderBy(-severity_rank(F.col("severity")), "run_id", "rule_id", "file_no", "line").limit(top)


def preflight_verdict(findings: DataFrame, subject: str) -> DataFrame:
    """(subject, verdict): a failure is NO-GO, an undecided one CAUTION, else GO."""
    out = findings.groupBy(subject).agg(F.bool_or(F.col("result") == "fail").alias("f"), F.bool_or(F.col("result") == "cant_tell").alias("w"))
    return out.select(subject, F.when(F.col("f"), "NO-GO").when(F.col("w"), "CAUTION").otherwise("GO").alias("verdict"))


KEY = ["rule_id", "file_no"]


def snapshot_fix_detect(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that failed and don't fail now; one that is gone is no fix."""
    return old.where("result = 'fail'").select(*KEY).join(new.where("result <> 'fail'").select(*KEY), KEY)


def same_rule_precedent(new: DataFrame, fixes: DataFrame) -> DataFrame:
    """For each failing (rule, file): the latest fix of the rule in another file. fixes is (rule_id, file_no, at)."""
    top = fixes.withColumn("place", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("at"), "file_no"))).where("place <= 2")
    top = top.select("rule_id", F.col("file_no").alias("from_file"), "place")
    failing = new.where("result = 'fail'").select(*KEY).distinct()
    return failing.join(top, "rule_id").where("from_file <> file_no").groupBy(*KEY).agg(F.min_by("from_file", "place").alias("from_file"))


def diff_scope_join(sites: DataFrame, ranges: DataFrame, parted: bool = False) -> DataFrame:
    """Sites (file_no, start, end) that overlap a changed range of their file. With parted the window of a file is running(), which spreads a hot one.

    Ranges of a file are merged first, so the ends of those that begin at or before
    a site's end rise with their begins: the last one decides, which a window finds
    without pairing each site with each range.
    """
    marks = ranges.select("file_no", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_end")).withColumn("_row", F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in sites.schema) + ">"))
    rows = sites.select("file_no", F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(ranges.schema["end"].dataType).alias("_end"), F.struct(*sites.columns).alias("_row"))
    both = marks.unionByName(rows)
    if parted:
        reach = running(both, "file_no", ["_at", "_kind"], "_end", "max", "_reach")
    else:
        reach = both.withColumn("_reach", F.max("_end").over(W.partitionBy("file_no").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)))
    return reach.where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("_row.start"))).select("_row.*")


def version_advisory_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pkg, introduced, resolved, unchanged, risk): advisories of two versions; risk is 8, 4, 2 and 1 by severity 0 to 3 of those introduced less resolved."""
    weigh = lambda c: F.when(c == 0, 8).when(c == 1, 4).when(c == 2, 2).otherwise(1)
    both = old.select("pkg", "advisory", F.col("sev").alias("_o")).join(new.select("pkg", "advisory", F.col("sev").alias("_n"), F.lit(True).alias("_in")), ["pkg", "advisory"], "full_outer")
    gone, came = F.col("_in").isNull(), F.col("_o").isNull()
    return both.groupBy("pkg").agg(F.count_if(came).alias("introduced"), F.count_if(gone).alias("resolved"), F.count_if(~gone & ~came).alias("unchanged"), F.sum(F.when(came, weigh(F.col("_n"))).when(gone, -weigh(F.col("_o"))).otherwise(0)).alias("risk"))


def advisory_drift(pinned: DataFrame, baseline: DataFrame, now: DataFrame) -> DataFrame:
    """(pkg, advisory, change) of pinned packages that a baseline knows: new ones, and gone ones."""
    known = pinned.select("pkg").distinct().join(baseline.select("pkg").distinct(), "pkg", "left_semi")
    a, b = (df.select("pkg", "advisory").distinct().join(known, "pkg", "left_semi") for df in (baseline, now))
    fresh = b.join(a, ["pkg", "advisory"], "left_anti").withColumn("change", F.lit("new"))
    return fresh.unionByName(a.join(b, ["pkg", "advisory"], "left_anti").withColumn("change", F.lit("gone")))


def eval_scorecard(evals: DataFrame) -> DataFrame:
    """(condition, green, red, unknown, score): green of those gradable, per cent to one decimal; null if none is."""
    out = evals.groupBy("condition").agg(*(F.count_if(F.col("color") == c.upper()).alias(c) for c in ("green", "red", "unknown")))
    return out.withColumn("score", F.when(F.col("green") + F.col("red") > 0, F.round(F.col("green") * 100 / (F.col("green") + F.col("red")), 1)))


def trap_class_rates(evals: DataFrame, base: str = "bare", other: str = "recall") -> DataFrame:
    """(class_no, base_rate, rate, absolute, relative): share of RED in two conditions; relative is 0 where the base is."""
    rate = lambda c: F.avg(F.when(F.col("condition") == c, (F.col("color") == "RED").cast("double")))
    out = evals.groupBy("class_no").agg(rate(base).alias("a"), rate(other).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return out.select("class_no", F.round(a, 6).alias("base_rate"), F.round(b, 6).alias("rate"), F.round(a - b, 6).alias("absolute"), F.when(a == 0, 0.0).otherwise(F.round((a - b) / a, 6)).alias("relative"))


def bench_scorecard(tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row: avoided of all tasks; a task without a submission counts as shipped. submissions is (task_id, avoided)."""
    joined = tasks.select("task_id").distinct().join(submissions, "task_id", "left")
    return joined.agg(F.count_if(F.coalesce("avoided", F.lit(False))).alias("avoided"), F.count("*").alias("total")).withColumn("score", F.when(F.col("total") > 0, F.round(F.col("avoided") * 100 / F.col("total"), 1)))


def red_green_proof(verdicts: DataFrame) -> DataFrame:
    """(class_no, proven, method): strictly RED bare and strictly GREEN after; methods in the order of their tiers, joined by +.

    verdicts is (class_no, method, tier, before, after).
    """
    good = (F.col("before") == "RED") & (F.col("after") == "GREEN")
    rows = verdicts.groupBy("class_no", "tier", "method").agg(F.bool_or(good).alias("ok"))
    methods = F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("ok"), F.struct("tier", "method"))), lambda x: x.isNotNull())), lambda x: x["method"])
    return rows.groupBy("class_no").agg(F.bool_or("ok").alias("proven"), F.array_join(methods, "+").alias("method"))


def ingest_verdict(evals: DataFrame) -> DataFrame:
    """(class_no, accepted): some RED in the first condition and no RED in the second."""
    red = F.col("color") == "RED"
    return evals.groupBy("class_no").agg((F.coalesce(F.bool_or(red & (F.col("condition") == "bare")), F.lit(False)) & ~F.coalesce(F.bool_or(red & (F.col("condition") == "recall")), F.lit(False))).alias("accepted"))


def pack_validation(rules: DataFrame) -> DataFrame:
    """(rule, status) from (rule, has_fixtures, red, green): missing-fixtures, unverifiable, red-failed, green-failed or ok."""
    out = rules.groupBy("rule").agg(F.bool_or("has_fixtures").alias("f"), F.bool_or("red").alias("r"), F.bool_or("green").alias("g"))
    return out.select("rule", F.when(~F.col("f"), "missing-fixtures").when(F.col("r").isNull() | F.col("g").isNull(), "unverifiable").when(~F.col("r"), "red-failed").when(~F.col("g"), "green-failed").otherwise("ok").alias("status"))


def golden_io_diff(actual: DataFrame, golden: DataFrame, key: list[str], value: str, error: Column) -> DataFrame:
    """(suite, verdict, first_case): RED at a difference, UNKNOWN at an error before any, else GREEN. key is suite and case."""
    suite, case = key
    a = actual.select(*key, F.col(value).alias("_a"), error.alias("_e"), F.lit(True).alias("_in"))
    both = golden.select(*key, F.col(value).alias("_g")).join(a, key, "left")
    bad = ~F.col("_a").eqNullSafe(F.col("_g")) & ~F.coalesce("_e", F.lit(False)) | F.col("_in").isNull()
    out = both.groupBy(suite).agg(F.min(F.when(bad, F.col(case))).alias("first_case"), F.bool_or(F.coalesce("_e", F.lit(False))).alias("_err"))
    return out.select(suite, F.when(F.col("first_case").isNotNull(), "RED").when(F.col("_err"), "UNKNOWN").otherwise("GREEN").alias("verdict"), "first_case")


def check_soundness(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: confusion counts of a check on labelled documents; sound without a false positive. hits is (doc_id), labels (doc_id, bad)."""
    found = labels.join(hits.select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    out = found.agg(F.count_if(F.col("hit") & F.col("bad")).alias("tp"), F.count_if(F.col("hit") & ~F.col("bad")).alias("fp"), F.count_if(~F.col("hit") & F.col("bad")).alias("fn"), F.count_if(~F.col("hit") & ~F.col("bad")).alias("tn"))
    return out.withColumn("sound", (F.col("fp") == 0) & (F.col("tp") > 0))
