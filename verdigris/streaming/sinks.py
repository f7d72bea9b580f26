"""Sinks for foreachBatch whose effect shows at once or not at all, and once however often a batch comes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources import commits

#: Buckets of a table, and manifests that stay readable besides the newest one.
BUCKETS, KEPT_MANIFESTS = 64, 1


class BucketTable:
    """A table in buckets by the hash of its key; a batch writes the buckets that it touches anew, and a manifest names them last.

    path/data/<write>/bucket=b holds a bucket as some write left it. path/manifests
    has a record for each batch: the write of every bucket. The newest record is the
    table. A batch that comes again finds its record and does nothing; one that
    failed before its record has left files that nobody names, which the next batch
    removes with those that no kept manifest names any more.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _record(self, batch_id: int) -> str:
        return f"{self.path}/manifests/{batch_id:012d}"

    def manifest(self) -> dict[int, str]:
        """Bucket -> write, of the newest record."""
        found = commits.names(self.spark, f"{self.path}/manifests")
        return {int(b): w for b, w in json.loads(commits.get(self.spark, f"{self.path}/manifests/{found[-1]}")).items()} if found else {}

    def _paths(self, manifest: dict[int, str]) -> list[str]:
        return [f"{self.path}/data/{write}/bucket={b}" for b, write in sorted(manifest.items())]

    def read(self) -> DataFrame | None:
        """The table as its newest manifest has it; None before the first batch."""
        paths = self._paths(self.manifest())
        return self.spark.read.parquet(*paths) if paths else None

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Merge a batch: merge(held rows of the touched buckets or None, batch) gives their new rows, by key."""
        if commits.exists(self.spark, self._record(batch_id)):
            return
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets))
        held = batch.persist()
        try:
            touched = sorted(r.bucket for r in held.select(bucket.alias("bucket")).distinct().collect())  # BUCKETS at most
            now = self.manifest()
            old = self._paths({b: now[b] for b in touched if b in now})
            merged = merge(self.spark.read.parquet(*old) if old else None, held)
            write = f"{batch_id}-{uuid.uuid4().hex}"
            if touched:
                merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
            full = now | dict.fromkeys(touched, write)
            commits.put_if_absent(self.spark, self._record(batch_id), json.dumps(full))
        finally:
            held.unpersist()
        self._clean()

    def _clean(self) -> None:
        records = commits.names(self.spark, f"{self.path}/manifests")
        for name in records[: -1 - KEPT_MANIFESTS]:
            commits.delete(self.spark, f"{self.path}/manifests/{name}")
        kept = [json.loads(commits.get(self.spark, f"{self.path}/manifests/{n}")) for n in records[-1 - KEPT_MANIFESTS :]]
        used = {(write, int(b)) for m in kept for b, write in m.items()}
        for write in commits.names(self.spark, f"{self.path}/data"):
            if not any(w == write for w, _ in used):
                commits.delete(self.spark, f"{self.path}/data/{write}")
                continue
            for name in commits.names(self.spark, f"{self.path}/data/{write}"):
                if (write, int(name.partition("=")[2])) not in used:
                    commits.delete(self.spark, f"{self.path}/data/{write}/{name}")


class Together:
    """Several tables that a batch writes and a reader sees together: a batch's record names its folder of each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Write all tables, then the record; nothing if the batch has its record."""
        record = f"{self.path}/commits/{batch_id:012d}"
        if commits.exists(self.spark, record):
            return
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{name}/{attempt}")
        commits.put_if_absent(self.spark, record, attempt)

    def batches(self) -> dict[int, str]:
        return {int(name): commits.get(self.spark, f"{self.path}/commits/{name}") for name in commits.names(self.spark, f"{self.path}/commits")}

    def read(self, name: str) -> DataFrame | None:
        """What the recorded batches wrote to a table; None before the first one."""
        paths = [f"{self.path}/{name}/{attempt}" for attempt in self.batches().values()]
        return self.spark.read.parquet(*paths) if paths else None


def usage_meter(path: str, served: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes the ledger rows of a batch and its delivery, and then the one record that shows both: what isn't metered isn't served."""

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            counts = held.groupBy(served).agg(F.count("*").alias("records_served")).withColumn("batch_id", F.lit(batch_id).cast("long"))
            Together(batch.sparkSession, path).write(batch_id, {"ledger": counts, "delivery": held})
        finally:
            held.unpersist()

    return each


def incremental_scan(path: str, scan: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that scans a batch of documents (doc_id, text) and writes its findings and, with them, the event that ends it.

    scan gives (rule_id, doc_id, result, line); what passes is no finding. The event
    is (batch_id, kind, documents, findings): scan_complete, also without documents
    or findings; or scan_error with the message, and then no findings.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        event = "batch_id long, kind string, documents long, findings long, message string"
        held = batch.persist()
        documents, found = held.count(), None
        try:
            found = scan(held).where("result <> 'pass'").persist()
            n = found.count()
            tables = {"findings": found, "events": spark.createDataFrame([(batch_id, "scan_complete", documents, n, None)], event)}
        except Exception as failed:  # the scan's own error is an event; that of the writes below isn't caught
            tables = {"events": spark.createDataFrame([(batch_id, "scan_error", documents, 0, str(failed).splitlines()[0][:500])], event)}
        Together(spark, path).write(batch_id, tables)
        held.unpersist()
        if found is not None:
            found.unpersist()

    return each
