"""Aggregates over a corpus of records: counts, coverage, balance, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import CLASSES, age_days, content_key, proven, quality_score, severity_rank
from verdigris.sources.tables import kept


def scored(records: DataFrame) -> DataFrame:
    """records with is_proven, score, content_key."""
    ok = proven(F.col("red"), F.col("green"))
    return records.withColumns({"is_proven": ok, "score": quality_score(F.col("severity"), F.col("corroboration"), ok), "content_key": content_key(F.col("trap_id"), F.col("sdk_name"), F.col("snippet"))})


def first_seen_dedup(records: DataFrame, key: str = "content_key", order: tuple[str, ...] = ("rec_no",)) -> DataFrame:
    """records with duplicate_of: the number of the first record of the same key, null on the first itself.

    The first of each key comes from an aggregate that combines before its
    shuffle, so a key that a third of the rows share doesn't land in one task.
    """
    first = records.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = records.join(first, records[key].eqNullSafe(F.col("_key")))
    own = F.struct(*order) == F.col("_first")
    return joined.withColumn("duplicate_of", F.when(~own, F.col(f"_first.{order[-1]}"))).drop("_key", "_first")


def first_seen_marks(records: DataFrame, key: Column, order: str = "rec_no") -> DataFrame:
    """(order, duplicate_of) of records: as first_seen_dedup(), but the key is worked out once and what is joined is narrow.

    (order, key) is a written table, so the texts behind a key are read once.
    """
    keys = kept(records.select(order, key.alias("_key")), "keys")
    first = keys.groupBy(F.col("_key").alias("_of")).agg(F.min(order).alias("_first"))
    met = keys.join(first, F.col("_key").eqNullSafe(F.col("_of")))
    return met.select(order, F.when(F.col(order) != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def unique(records: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The first record of each content key; of so many columns, in one aggregate that combines before its shuffle."""
    if columns is None:
        return first_seen_dedup(scored(records)).where("duplicate_of IS NULL")
    rows = scored(records).select("content_key", "rec_no", F.struct(*columns).alias("_row"))
    return rows.groupBy("content_key").agg(F.min_by("_row", "rec_no").alias("_row")).select("_row.*")


def corpus_counts(records: DataFrame) -> DataFrame:
    """One row: total, unique, duplicate, sdks, classes."""
    s = scored(records)
    return s.agg(F.count("*").alias("total"), F.countDistinct("content_key").alias("unique_records"), (F.count("*") - F.countDistinct("content_key")).alias("duplicates"), F.countDistinct("sdk_name").alias("sdks"), F.countDistinct("class").alias("classes"))


def distributions(records: DataFrame, dims: tuple[str, ...] = ("severity", "class", "sdk_name", "license")) -> DataFrame:
    """(dim, value, n) of unique records, all dimensions in one pass; a missing value is unknown."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit("unknown")).alias("value")) for d in dims))
    return unique(records, dims).select(F.inline(pairs)).groupBy("dim", "value").agg(F.count("*").alias("n"))


def quality_summary(records: DataFrame) -> DataFrame:
    """One row over unique records: rounded mean and median, least, most, and buckets from 70 and from 40."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    half_up = lambda c: F.floor(c + 0.5)
    return unique(records, ("score",)).agg(
        zero(half_up(F.avg("score"))).alias("mean_score"),
        zero(half_up(F.percentile("score", F.lit(0.5)))).alias("median_score"),
        zero(F.min("score")).alias("min_score"),
        zero(F.max("score")).alias("max_score"),
        F.count_if(F.col("score") >= 70).alias("high"),
        F.count_if(F.col("score").between(40, 69)).alias("medium"),
        F.count_if(F.col("score") < 40).alias("low"),
    )


def coverage_matrix(records: DataFrame) -> DataFrame:
    return unique(records).groupBy("class", "sdk_name").agg(F.count("*").alias("n"))


def thin_cells(records: DataFrame) -> DataFrame:
    return coverage_matrix(records).where("n = 1")


def class_domain(records: DataFrame) -> DataFrame:
    """(class, ord): the taxonomy."""
    return records.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CLASSES)], "class string, ord int")


def missing_classes(records: DataFrame) -> DataFrame:
    """Classes without a record; the catch-all is never missing."""
    return class_domain(records).where("class <> 'other'").join(records.select("class").distinct(), "class", "left_anti").select("class")


def class_budget(records: DataFrame) -> DataFrame:
    """(class, n, total, status, need, room) for each class of the taxonomy.

    Surplus from a quarter of all, deficit under a twentieth (never the catch-all).
    need records lift a class to a twentieth, room are left to a quarter; both move
    the total too.
    """
    counts = records.groupBy("class").agg(F.count("*").alias("n"))
    known = class_domain(records).join(counts, "class", "left").select("class", "ord", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # nine rows
    status = F.when(F.col("n") * 4 >= F.col("total"), "surplus").when((F.col("class") != "other") & (F.col("n") * 20 < F.col("total")), "deficit").otherwise("ok")
    need = F.greatest(F.ceil((F.col("total") - 20 * F.col("n")) / 19), F.lit(0)).cast("long")
    room = F.greatest(F.floor((F.col("total") - 4 * F.col("n")) / 3), F.lit(0)).cast("long")
    return known.withColumn("total", total).select("class", "ord", "n", "total", F.when(F.col("total") == 0, "ok").otherwise(status).alias("status"), need.alias("need"), room.alias("room"))


def class_gate(submissions: DataFrame, records: DataFrame) -> DataFrame:
    """submissions (class) with admitted and the three scarcest classes; unknown classes count as the catch-all."""
    budget = class_budget(records)
    scarce = budget.where("class <> 'other'").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("n", "ord", "class"))), lambda x: x["class"]), 1, 3), ",").alias("suggest"))
    judged = F.when(F.col("class").isin(*CLASSES), F.col("class")).otherwise("other")
    of = budget.select(F.col("class").alias("_class"), (F.col("status") != "surplus").alias("admitted"))
    out = submissions.withColumn("_judged", judged).join(F.broadcast(of), F.col("_judged") == F.col("_class")).join(F.broadcast(scarce), F.lit(True))
    return out.withColumn("suggest", F.when(~F.col("admitted"), F.col("suggest"))).drop("_judged", "_class")


def scout_work_order(records: DataFrame) -> DataFrame:
    """Classes to look for: not in surplus, not the catch-all, scarcest first."""
    rows = class_budget(records).where("status <> 'surplus' AND class <> 'other'")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("n", F.desc("need"), "ord"))).select("place", "class", "n", "need")


def thin_cell_demand_rank(records: DataFrame, demand: DataFrame) -> DataFrame:
    """Thin cells by demand: hits of the class and of the SDK. demand is (kind, name, hits), kind class or sdk."""
    cells = thin_cells(records).select("class", "sdk_name")
    of = lambda kind, col: demand.where(F.col("kind") == kind).select(F.col("name").alias(col), F.col("hits").alias(f"{kind}_hits"))
    joined = cells.join(of("class", "class"), "class", "left").join(of("sdk", "sdk_name"), "sdk_name", "left")
    return joined.select("class", "sdk_name", (F.coalesce("class_hits", F.lit(0)) + F.coalesce("sdk_hits", F.lit(0))).alias("demand"))


def catalog_summary(records: DataFrame) -> DataFrame:
    """One row over proven records, duplicates included."""
    s = scored(records).where("is_proven")
    return s.agg(F.count("*").alias("records"), F.countDistinct("sdk_name").alias("sdks"), F.countDistinct("class").alias("classes"), F.floor(F.avg("score") + 0.5).cast("int").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.min("captured_at").alias("oldest"), F.max("captured_at").alias("newest"))


def hive_status(records: DataFrame) -> DataFrame:
    """A row for each lot: totals, proven, with payload, critical, newest, SDKs."""
    s = scored(records)
    return s.groupBy("lot").agg(F.count("*").alias("records"), F.count_if("is_proven").alias("proven"), F.count_if(F.length("snippet") > 0).alias("with_payload"), F.count_if(F.col("severity") == "critical").alias("critical"), F.max("captured_at").alias("newest"), F.countDistinct("sdk_name").alias("sdks"))


def _rate(part: Column, whole: Column) -> Column:
    """To four decimals; 1 of nothing."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, 4))


def sla_report(records: DataFrame, verifiable: Column, now: int) -> DataFrame:
    """A row for each lot: valid, reproduced, unverifiable, ages in days, and the rate of reproduction."""
    s = scored(records).withColumn("age", F.floor(age_days(F.col("captured_at"), now))).withColumn("_can", verifiable)
    valid = F.coalesce((F.length("snippet") > 0) & F.col("class").isin(*CLASSES) & (severity_rank(F.col("severity")) > 0), F.lit(False))
    out = s.groupBy("lot").agg(F.count("*").alias("records"), F.count_if(valid).alias("valid"), F.count_if(F.col("_can") & F.col("is_proven")).alias("reproduced"), F.count_if("_can").alias("_checked"), F.count_if(~F.col("_can")).alias("unverifiable"), F.floor(F.percentile("age", F.lit(0.5)) * 2).cast("long").alias("twice_median_age"), F.max("age").cast("long").alias("max_age"))
    return out.withColumn("rate", _rate(F.col("reproduced"), F.col("_checked"))).drop("_checked")


def export_manifest(records: DataFrame) -> DataFrame:
    """(class, drop_reason, n): what an export keeps (reason kept) and drops."""
    from verdigris.operators.access import copyleft_exclusion

    rows = copyleft_exclusion(scored(records))
    reason = F.when(~F.col("is_proven"), "unproven").otherwise(F.coalesce("drop_reason", F.lit("kept")))
    return rows.groupBy("class", reason.alias("drop_reason")).agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring("content_key", 1, 8), 16, 10).cast("long")).alias("digest"))


def dataset_package(records: DataFrame, path: str, sample: int = 3) -> DataFrame:
    """Write a data set under path and return its index: (part, name, n, digest).

    full holds all records and sample the first by trap and number, both as JSON
    lines. The index is made from what was written: counts and digests of both
    parts, and of full by class, severity and SDK. A digest is the exclusive or of
    the heads of its records' SHA-256; sources.files.checksums gives those of the files.
    """
    spark = records.sparkSession
    records.write.json(f"{path}/full")
    records.orderBy("trap_id", "rec_no").limit(sample).write.json(f"{path}/sample")
    full, first = (spark.read.schema(records.schema).json(f"{path}/{part}") for part in ("full", "sample"))
    head = F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("rec_no", "trap_id", "sdk_name", "class", "severity", "snippet"))), 256), 1, 8)
    digest = F.bit_xor(F.conv(head, 16, 10).cast("long")).alias("digest")
    whole = lambda df, part: df.groupBy(F.lit(part).alias("part"), F.lit("records").alias("name")).agg(F.count("*").alias("n"), digest)
    pairs = F.array(*(F.struct(F.lit(d).alias("part"), F.coalesce(F.col(d), F.lit("unknown")).alias("name")) for d in ("class", "severity", "sdk_name")))
    by = full.select("*", F.inline(pairs)).groupBy("part", "name").agg(F.count("*").alias("n"), digest)
    return whole(full, "full").unionByName(whole(first, "sample")).unionByName(by)
