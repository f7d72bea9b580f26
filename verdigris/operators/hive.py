"""Experience events, dependencies and demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import severity_rank
from verdigris.operators.access import proven_filter
from verdigris.operators.corpus import scored


def dependency_match(deps: DataFrame, records: DataFrame) -> DataFrame:
    """(repo_id, dep, record columns): a dependency is a record's SDK when the names are equal in any case."""
    left = deps.withColumn("_name", F.lower("dep"))
    right = records.withColumn("_name", F.lower("sdk_name"))
    return left.join(right, "_name").drop("_name")


def outbreak_match(new: DataFrame, deps: DataFrame, least: str = "high") -> DataFrame:
    """A row for each new proven record of at least a severity that some repository depends on, with its repositories."""
    grave = proven_filter(new).where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))
    names = grave.groupBy("rec_no", "trap_id", "severity").agg(F.array_sort(F.collect_set(F.lower("sdk_name"))).alias("_names"))
    # Repositories are gathered once for each set of names, mostly one name, and not once a record.
    asked = names.select("_names").distinct().select("_names", F.explode("_names").alias("_name"))
    on = deps.select("repo_id", F.lower("dep").alias("_name")).distinct()
    known = asked.join(on, "_name").groupBy("_names").agg(F.sort_array(F.collect_set("repo_id")).alias("repos"))
    return names.join(known, "_names").select("rec_no", "trap_id", "severity", F.size("repos").cast("long").alias("breadth"), "repos")


def demand_signal(events: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, name, hits, repos): events by rule, class and SDK. events has trap_id; its first record tells class and SDK."""
    first = records.groupBy("trap_id").agg(F.min_by(F.struct("class", "sdk_name"), "rec_no").alias("_r")).select("trap_id", F.col("_r.class").alias("class"), F.col("_r.sdk_name").alias("sdk"))
    told = events.join(first, "trap_id", "left")
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("rule", "trap_id"), ("class", "class"), ("sdk", "sdk"))))
    seen = told.select("repo_id", F.inline(pairs)).where("name IS NOT NULL")
    return seen.groupBy("kind", "name").agg(F.count("*").alias("hits"), F.countDistinct("repo_id").alias("repos"))


def unresolved_rules(events: DataFrame, records: DataFrame) -> DataFrame:
    return events.join(records.select("trap_id").distinct(), "trap_id", "left_anti").groupBy("trap_id").agg(F.count("*").alias("hits"))


def skip_investigated(candidates: DataFrame, log: DataFrame, days: int, now: str) -> DataFrame:
    """candidates whose repository has no investigation in the last days; one without a time is stale."""
    recent = log.where(F.col("fixed_at") >= F.expr(f"TIMESTAMP '{now}' - INTERVAL {days} DAYS")).select("repo_id").distinct()
    return candidates.join(recent, "repo_id", "left_anti")


def cross_repo_precedent(events: DataFrame) -> DataFrame:
    """(rule_id, repo_id, from_repo, at): the latest event of the rule in another repository.

    The two latest repositories of each rule are enough: the own one is at most one of them.
    """
    per = events.groupBy("rule_id", "repo_id").agg(F.max(F.struct("fixed_at", "event_id")).alias("last"))
    top = per.withColumn("place", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("last")))).where("place <= 2")
    best = top.select("rule_id", F.col("repo_id").alias("from_repo"), F.col("last").alias("_last"))
    pairs = per.select("rule_id", "repo_id").join(best, "rule_id").where("from_repo <> repo_id")
    return pairs.groupBy("rule_id", "repo_id").agg(F.max_by("from_repo", "_last").alias("from_repo"), F.max("_last.fixed_at").alias("at"))


def latest_fix_per_rule(events: DataFrame) -> DataFrame:
    """The most recent event of each rule; of equal times the first."""
    return events.groupBy("rule_id").agg(F.max_by("event_id", F.struct("fixed_at", (-F.col("event_id")).alias("n"))).alias("event_id"), F.max("fixed_at").alias("fixed_at"))


def acl_semi_join(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Events that their space's policy lets through: open, or the author is an admin or allowed. policies is (repo_id, open, admins, allowed)."""
    ok = F.col("open") | F.array_contains(F.concat("admins", "allowed"), F.col("author"))
    return events.join(policies, "repo_id").where(F.coalesce(ok, F.lit(False))).select(*events.columns)


def author_block(events: DataFrame, blocked: DataFrame, own: int) -> DataFrame:
    return events.where(F.col("author") != own).join(blocked.select("author").distinct(), "author", "left_anti").select(*events.columns)


def experience_dashboard(events: DataFrame, top: int = 20) -> DataFrame:
    """(kind, name, n, place): totals, the top of rules, repositories and authors, and events by day."""
    dims = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in (("rule", "rule_id"), ("repo", "repo_id"), ("author", "author"))), F.struct(F.lit("day").alias("kind"), F.to_date("fixed_at").cast("string").alias("name")))
    counts = events.select(F.inline(dims)).select("kind", F.coalesce("name", F.lit("local")).alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    # The limit is on the place alone, so each task sends on its best of a kind and no more; days are few, and numbered apart.
    w = W.partitionBy("kind").orderBy(F.desc("n"), "name")
    best = counts.where("kind <> 'day'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    days = counts.where("kind = 'day'").withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy("name")))
    ranked = best.unionByName(days)
    totals = counts.where("kind <> 'day'").groupBy(F.concat(F.lit("distinct-"), "kind").alias("kind")).agg(F.lit("").alias("name"), F.count("*").alias("n")).withColumn("place", F.lit(1))
    return ranked.unionByName(totals)


def graduation_count(events: DataFrame, least: int = 5) -> DataFrame:
    """(rule_id, pairs, graduated): distinct pairs of repository and author."""
    return events.groupBy("rule_id").agg(F.countDistinct("repo_id", "author").alias("pairs")).withColumn("graduated", F.col("pairs") >= least)


def corroboration_count(records: DataFrame, events: DataFrame) -> DataFrame:
    """(rec_no, confirmed): distinct repositories with an event of the record's trap."""
    seen = events.groupBy("trap_id").agg(F.countDistinct("repo_id").alias("confirmed"))
    return records.join(seen, "trap_id", "left").select("rec_no", F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


def brief_rank(deps: DataFrame, records: DataFrame, fixed: DataFrame, top: int = 12) -> DataFrame:
    """The brief of each repository: (repo_id, place, trap_id, sdk_name, class, score, instances, corroboration, personal).

    Proven records of its dependencies, personally fixed ones first, then by score,
    severity and time; those of the same SDK and class are one entry, led by the
    first; entries rank again by score and how many they stand for. fixed is (trap_id).
    """
    known = fixed.select("trap_id").distinct().withColumn("personal", F.lit(True))
    rows = scored(records).where("is_proven").select(F.lower("sdk_name").alias("sdk_name"), "rec_no", "trap_id", "class", "severity", "score", "corroboration", "captured_at")
    rows = rows.join(known, "trap_id", "left").withColumn("personal", F.coalesce("personal", F.lit(False)))
    lead = F.struct("personal", "score", severity_rank(F.col("severity")).alias("rank"), "captured_at", (-F.col("rec_no")).alias("n"))
    # An entry is the same for every repository that has its SDK: records are gathered before they meet dependencies.
    led = rows.groupBy("sdk_name", "class").agg(F.max_by(F.struct("trap_id", "score", "captured_at", "rec_no"), lead).alias("e"), F.count("*").alias("_n"), F.max("corroboration").alias("corroboration"), F.max("personal").alias("personal"))
    own = deps.groupBy("repo_id", F.lower("dep").alias("sdk_name")).agg(F.count("*").alias("_times"))
    entries = own.join(led, "sdk_name").withColumn("instances", F.col("_n") * F.col("_times"))
    weight = F.col("e.score") + F.least(F.col("instances") - 1, F.lit(20))
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("personal"), F.desc(weight), F.desc("e.captured_at"), "e.rec_no"))
    return entries.withColumn("place", place).where(F.col("place") <= top).select("repo_id", "place", "e.trap_id", "sdk_name", "class", "e.score", "instances", "corroboration", "personal")


def brief_totals(deps: DataFrame, records: DataFrame, top: int = 12) -> DataFrame:
    """(repo_id, dep_count, matched_deps, unmatched_deps, entries, truncated) of each repository's brief: what brief_rank() leaves out.

    deps is (repo_id, dep). Dependencies that differ in case only count each;
    entries are those before the limit, truncated how many it cuts.
    """
    own = deps.select("repo_id", "dep").distinct()
    known = scored(records).where("is_proven").select(F.lower("sdk_name").alias("_sdk"), "class").distinct()
    met = own.join(known, F.lower("dep") == F.col("_sdk"))
    entries = met.groupBy("repo_id").agg(F.countDistinct("_sdk", "class").alias("entries"), F.countDistinct("dep").alias("matched_deps"))
    counts = own.groupBy("repo_id").agg(F.count("*").alias("dep_count")).join(entries, "repo_id", "left").fillna(0, ["entries", "matched_deps"])
    return counts.select("repo_id", "dep_count", "matched_deps", (F.col("dep_count") - F.col("matched_deps")).alias("unmatched_deps"), "entries", F.greatest(F.col("entries") - top, F.lit(0)).alias("truncated"))


def worklist_topk(candidates: DataFrame, least: float, top: int) -> DataFrame:
    """Repositories of enough stars, each once, the best first. candidates is (repo_id, stars)."""
    return candidates.groupBy("repo_id").agg(F.max("stars").alias("stars")).where(F.col("stars") >= least).orderBy(F.desc("stars"), "repo_id").limit(top)
