"""Exact deduplication by Grace hashing.

Two rounds of hash tables that compare complete contents:

1. Each scan partition keeps a table of the texts it has seen and emits one
   representative a distinct text. A table past its memory budget is emitted and
   begun anew. So a text that makes up a third of the corpus leaves a partition a
   few times, not once a row, and no shuffle partition grows hot.
2. Representatives are partitioned by hash bits to bucket files. Buckets that fit an
   open-addressing table are done; those that don't are partitioned again by further
   bits, to new files, until each fits or its texts share their whole hash.

Bucket files are tables in the folder that all machines share, so nothing is kept on
one machine, and a lost executor costs the tasks it had. Rows then join their class
by the representative's number, which at most one table's rows share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import KeyFilter, mapped, named, narrow_side, sliced, written

#: Bytes that one table holds; a task has one table at a time.
TABLE_BYTES = 24 << 20
#: What an entry of a table takes beside its content: its slot, its hash, its objects.
ENTRY_BYTES = 200
#: Bits by which a bucket that doesn't fit is partitioned again.
SPLIT_BITS = 4


class Table:
    """Open addressing with linear probing; a slot matches when the whole content does."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, text: bytes, h: int) -> int:
        """The class number of text, a new one if it wasn't there."""
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return k
            at = (at + 1) & self.mask
        k = len(self.texts)
        self.slots[at] = k
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + ENTRY_BYTES
        if 2 * k > self.mask:
            self.grow()
        return k

    def grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k


LOCAL = pa.schema([("row_id", pa.int64()), ("place", pa.int64()), ("local_id", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("h", pa.int64()), ("takes", pa.int64())])
_LOCAL = "row_id long, place long, local_id long, sha string, text binary, h long, takes long"


def _combine(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Round 1: each row with its own number and that of its representative, whose row carries the text."""
    number = place = TaskContext.get().partitionId() << 40
    table, shas = Table(), []
    for batch in sliced(batches, "text"):
        out: dict[str, list] = {name: [] for name in LOCAL.names}
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            content = (text or "").encode()
            h = xxhash.xxh3_64_intdigest(content)
            k = table.find(content, h)
            new = k == len(shas)
            if new:
                shas.append(hashlib.sha256(content).hexdigest())
            for name, value in zip(LOCAL.names, (row_id, place, number + k, shas[k], content if new else None, h - (1 << 63), len(content) + ENTRY_BYTES), strict=True):
                out[name].append(value)
            place += 1
        yield pa.RecordBatch.from_pydict(out, LOCAL)
        if table.bytes > budget:
            number += len(shas)
            table, shas = Table(), []


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2, rows (bucket, local_id, text, h) sorted by bucket: for each representative, the least number of its class."""
    now, table, members = None, Table(), []
    schema = pa.schema([("local_id", pa.int64()), ("class_id", pa.int64())])

    def classes() -> Iterator[pa.RecordBatch]:
        ids, least = [i for some in members for i in some], [m for some in members for m in [min(some)] * len(some)]
        for at in range(0, len(ids), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000], pa.int64()), pa.array(least[at : at + 10_000], pa.int64())], schema=schema)

    for batch in sliced(batches, "text"):
        for bucket, local_id, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from classes()
                now, table, members = bucket, Table(), []
            k = table.find(text, h)
            if k == len(members):
                members.append([])
            members[k].append(local_id)
    yield from classes()


def grace(held: DataFrame, budget: int = TABLE_BYTES, bits: int | None = None) -> DataFrame:
    """(local_id, class_id) of representatives (local_id, text, h, takes): the least number of those with the same text.

    takes is what an entry needs: the length of the text and ENTRY_BYTES.

    Buckets go by the first bits of h, at first by so many that tables are filled
    to a half. What a bucket takes is summed by an aggregate; those over the budget
    are written on to the next round, with SPLIT_BITS more bits. A bucket of one
    hash can't be parted: equal texts take one entry of its table.
    """
    if bits is None:
        bits = min(40, max(0, 2 * (held.agg(F.sum("takes")).first()[0] or 0) // budget).bit_length())
    out = None
    while True:
        keyed = held.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
        sizes = keyed.groupBy("bucket").agg(F.sum("takes").alias("takes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        large = written(sizes.where((F.col("takes") > budget) & (F.col("lo") != F.col("hi"))).select("bucket"), "large_buckets")
        some = not large.isEmpty()
        fit = keyed.join(large, "bucket", "left_anti") if some else keyed
        fit = fit.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "local_id", "text", "h")
        found = mapped(fit, _classes, "local_id long, class_id long")
        out = found if out is None else out.unionByName(found)
        if not some:
            return out
        held = written(keyed.join(large, "bucket", "left_semi").drop("bucket"), "bucket_files")
        bits = min(64, bits + SPLIT_BITS)


def _classified(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """(row_id, place, local_id, sha, keep_id, group_size, kept): place is the number of the row, the same in every reading of the result."""
    rows = docs.select(named(id_col).cast("long").alias("row_id"), named(text_col).cast("string").alias("text"))
    local = written(mapped(rows, lambda it: _combine(it, budget), _LOCAL), "local_texts")
    classes = grace(local.where("text IS NOT NULL").select("local_id", "text", "h", "takes"), budget)
    # What a class holds is summed by representative first: a row for each, not each document.
    stays = F.struct(F.coalesce("row_id", F.lit(-(2**63))), -F.col("place"))
    per_local = local.groupBy("local_id").agg(F.count("*").alias("n"), F.max_by(F.struct("row_id", "place"), stays).alias("lead"), F.max(stays).alias("order"))
    joined = written(per_local.join(classes, "local_id"), "classes")
    total = joined.groupBy("class_id").agg(F.sum("n").alias("group_size"), F.max_by("lead", "order").alias("lead"))
    of_local = joined.select("local_id", "class_id").join(total, "class_id").select("local_id", "group_size", F.col("lead.row_id").alias("keep_id"), F.col("lead.place").alias("keep_place"))
    met = local.select("row_id", "place", "local_id", "sha").join(of_local, "local_id")
    return met.withColumn("kept", F.col("place") == F.col("keep_place"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row a document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest id stays; a null id is smaller than any other. Rows that
    repeat both id and text count each; all of them carry the same id, so one of
    them stays. Empty texts form a group like any other, and texts of any length
    are compared whole. An empty table gives no rows. Other columns, whatever their
    names, are not read.
    """
    found = _classified(docs, id_col, text_col, table_bytes)
    return found.select(F.col("row_id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Rows are told by id and digest. Those that share both with the row that stays
    are repeats of it, of which one is taken. Rows that a filter of the keys of
    larger groups doesn't know are alone and stay where they are; only the others
    are shuffled to meet their group.
    """
    key = F.xxhash64("row_id", "sha")
    found = _classified(docs, id_col, text_col, TABLE_BYTES).where("group_size > 1")
    grouped = written(found.groupBy("row_id", "sha").agg(F.max("kept").alias("stays")), "grouped")
    known = KeyFilter(grouped.select(key.alias("key")))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    marked = docs.select(F.struct("*").alias("row"), named(id_col).cast("long").alias("row_id"), F.sha2(text, 256).alias("sha")).withColumn("known", known.may_have(key))
    alone = marked.where("NOT known").select("row.*")
    met = marked.where("known").alias("m").join(narrow_side(grouped).alias("g"), F.expr("m.row_id <=> g.row_id AND m.sha = g.sha"), "left").select("m.row", "m.row_id", "m.sha", "g.stays")
    # Without a group a row was let through in vain, and its repeats, if there were any, would be a group: it is alone.
    one = met.where("stays IS NULL OR stays").groupBy("row_id", "sha").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(one)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON g.text = t.text
"""
