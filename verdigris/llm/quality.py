"""Quality by importance resampling.

Two bag models over hashed n-grams: the target, fitted on a bounded sample of rows
labelled as good, and raw text, counted over every document. A document's log
weight is the log likelihood ratio of the two models: the sum, over all its
n-grams, of the log ratio of their buckets. Standard Gumbel noise on the log
weights and an exact top-k draw k documents without replacement, in proportion to
their weights. k is a target size: the share of good rows among those labelled, of
all documents that have a word.

Features are words and word pairs, and the shapes of words (letters, capitals,
digits and other characters in their places) and of word pairs: shapes tell the
kinds of junk apart in any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import lean_batches, mapped, named, sliced, written

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: At most so many labelled rows are used to fit the target and its size.
MOST_LABELLED = 20_000
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 57 if 48 <= b < 58 else b for b in range(256))


def features(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, with repeats; none if it has no word."""
    raw = text.encode()
    parts = []
    for seed, words in enumerate((raw.split(), raw.translate(_SHAPE).split())):
        if words:
            h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(seed << 32)
            pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            parts += [h, pairs ^ np.uint64(1 << 40)]
    if not parts:
        return np.zeros(0, np.int64)
    mixed = np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in sliced(batches, "text"):
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = np.bincount(features(text or ""), minlength=BUCKETS)
            raw += seen
            if good:
                target += seen
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "raw": raw[at], "target": target[at]})


def labelled_sample(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(label_id, good): at most so many labelled ids, those of the least hash; good if every label says quality 1."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("label_id"), "good")


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray | None:
    """log target / raw for each bucket, or None if there is no good document to learn from.

    The sample is broadcast: its size is bounded by a parameter. Each task sends
    on its own sums, and the driver gets one row for each bucket.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.join(F.broadcast(sample.where("good")), F.col("doc_id") == F.col("label_id"), "left").select("text", "good")
    sums = mapped(texts, _counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not target.sum():
        return None
    return np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))


def log_weight(text: Column, model: np.ndarray) -> Column:
    """The sum of log ratios over a text's features; null for a text without words. Only texts go to Python, other columns don't."""

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            for t in texts.slice(at, 256).to_pylist():
                found = features(t or "")
                out.append(float(model[found].sum()) if len(found) else None)
        return pa.array(out, pa.float64())

    return weigh(text)


def gumbel(doc_id: Column, text: Column) -> Column:
    """Standard Gumbel noise from a hash of id and text: the same for equal rows, in any run."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(1), doc_id, text), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs with quality_score, the log weight, and draw_key, log weight and noise in fixed point. Null texts count as empty."""
    lean_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    with_score = docs.drop("quality_score", "draw_key").withColumn("quality_score", log_weight(text, model))
    key = F.floor((F.col("quality_score") + gumbel(F.col("doc_id"), text)) * float(1 << 24)).cast("long")
    return with_score.withColumn("draw_key", key)


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of a column key of longs: four rounds of counts by 16 bits, each of at most 65,536 rows."""
    found = 0
    rows = keys.select((F.col("key").bitwiseXOR(F.lit(-(2**63)))).alias("key"))  # now ordered as unsigned
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(0xFFFF))
        inside = rows if shift == 48 else rows.where(F.shiftrightunsigned("key", shift + 16) == found)
        for at, n in sorted(((r.digit, r.n) for r in inside.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True):
            if k <= n:
                found = found << 16 | at
                break
            k -= n
    return found - (1 << 63)


def target_size(sample: DataFrame, n: int) -> int:
    """The share of good rows in the labelled sample, of n."""
    share = sample.agg(F.avg(F.col("good").cast("double"))).first()[0]
    return round(n * share)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs (or so many columns of it) with quality_score and kept: the k documents that importance resampling draws.

    Without k it is the target's size: the share of good rows among those
    labelled, of all documents that have a word. Texts without a word have no
    score and aren't drawn. Equal rows share their fate, so the last of them may
    exceed k. Without a good label everything with a word is kept; an empty table
    gives no rows. Null and repeated ids are harmless, and texts of any length are
    read whole. Columns named quality_score, draw_key or kept are replaced; other
    columns may have any name.

    Each text is read twice: for the raw model, and for its score. The scored rows
    are a written table, from which the draw is made.
    """
    docs = docs.drop("quality_score", "draw_key", "kept")
    columns = docs.columns if columns is None else columns
    sample = written(labelled_sample(labels), "labelled")
    model = log_ratios(docs, sample)
    taken = scored(docs, np.zeros(BUCKETS) if model is None else model)
    everything = written(taken.select(*map(named, columns), "quality_score", "draw_key"), "scored")
    if model is None:
        return everything.withColumn("kept", F.col("quality_score").isNotNull()).drop("draw_key")
    keys = everything.select(F.col("draw_key").alias("key")).where("key IS NOT NULL")
    n = keys.count()
    k = target_size(sample, n) if k is None else k
    least = kth_largest(keys, k) if 0 < k < n else 2**63 - 1 if k <= 0 else -(2**63)
    return everything.withColumn("kept", F.coalesce(F.col("draw_key") >= least, F.lit(False))).drop("draw_key")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weigh all documents and draw those that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id"]).select("doc_id", F.round("quality_score", 6).alias("quality_score"), "kept")
