"""What the operators of this folder share: written tables, Arrow slices, row keys, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes after which a batch for Python is closed; a row is never cut.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder is taken.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows up to which narrow_side() asks for a broadcast.
BROADCAST_ROWS = 200_000
#: Folders that written() has made since a scope was opened, for each open scope.
_SCOPES: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no earlier stage, and what a
    task numbered by itself stays as it was. The table lives until the scope that it
    was written in is closed, or else as long as the cluster keeps its folder.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/verdigris/{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def narrow_side(table: DataFrame, most: int | None = None) -> DataFrame:
    """A table of narrow rows, cheap to count, to be broadcast if it has so many at most: wide rows then meet it where they are."""
    return F.broadcast(table) if table.count() <= (BROADCAST_ROWS if most is None else most) else table


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like written(), for results; all other tables that are written inside are removed at the end."""
    own: list[str] = []
    _SCOPES.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        own.pop()
        return out

    try:
        yield keep
    finally:
        _SCOPES.remove(own)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in own:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class KeyFilter:
    """Which rows may have a key of a set: a Bloom filter in chunks, of a bounded size.

    Whoever isn't in it has none of the keys, so wide rows need no shuffle to be held
    against a narrow set; who may be in it takes an exact join. Up to MOST_BITS / 16
    keys one row in four hundred is let through in vain; beyond that more are, up to
    all: the result of the join behind it is the same.
    """

    MOST_BITS, CHUNK_BITS, PROBES = 1 << 28, 1 << 19, 4

    def __init__(self, keys: DataFrame) -> None:
        """keys has one column of longs."""
        spark, name = keys.sparkSession, keys.columns[0]
        keys = keys.select(F.col(name).alias("key")).where("key IS NOT NULL")
        self.chunks = 1
        n = keys.count()
        while self.chunks * self.CHUNK_BITS < min(16 * n, self.MOST_BITS):
            self.chunks *= 2
        chunks, bits = self.chunks, self.CHUNK_BITS
        placed = keys.withColumn("chunk", F.shiftrightunsigned("key", 40).bitwiseAND(F.lit(chunks - 1)).cast("int"))
        made = mapped(placed.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "key"), lambda it: _chunk_bits(it, bits), "chunk int, bits binary").collect()
        table = np.zeros((chunks, bits // 8), np.uint8)
        for row in made:
            table[row.chunk] |= np.frombuffer(row.bits, np.uint8)
        self.table = spark.sparkContext.broadcast(table.tobytes())

    def may_have(self, key: Column) -> Column:
        """Whether a long may be one of the keys; false for null. Only this column goes to Python."""
        table, chunks, bits = self.table, self.chunks, self.CHUNK_BITS

        @F.arrow_udf("boolean")
        def test(keys: pa.Array) -> pa.Array:
            return pa.array(_known(keys, table.value, chunks, bits))

        return test(key)

    def holds(self) -> Callable[[pa.Array], np.ndarray]:
        """A function for tasks that tells which longs may be keys."""
        table, chunks, bits = self.table, self.chunks, self.CHUNK_BITS
        return lambda keys: _known(keys, table.value, chunks, bits)

    def how_many(self, keys: Column | str) -> Column:
        """How many longs of an array may be keys; none for null."""
        table, chunks, bits = self.table, self.chunks, self.CHUNK_BITS

        @F.arrow_udf("int")
        def count(lists: pa.Array) -> pa.Array:
            upto = np.concatenate(([0], np.cumsum(_known(lists.flatten(), table.value, chunks, bits))))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            return pa.array(upto[ends] - upto[ends - sizes], pa.int32())

        return count(keys)


def _known(keys: pa.Array, table: bytes, chunks: int, bits: int) -> np.ndarray:
    held = np.frombuffer(table, np.uint8).reshape(chunks, bits // 8)
    k = keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    chunk = (k >> np.uint64(40) & np.uint64(chunks - 1)).astype(np.int64)
    hit = np.ones(len(k), bool)
    for at in _bit_places(k, bits):
        hit &= (held[chunk, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit & keys.is_valid().to_numpy(zero_copy_only=False)


def _bit_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = keys >> np.uint64(20) | np.uint64(1)
    for i in range(KeyFilter.PROBES):
        yield ((keys + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _chunk_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(chunk, bits) from (chunk, key), sorted by chunk."""
    now, held = None, np.zeros(bits // 8, np.uint8)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        chunk, key = (batch.column(i).to_numpy() for i in range(2))
        edges = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(chunk)], strict=True):
            if chunk[a] != now:
                if now is not None:
                    yield row()
                now, held = int(chunk[a]), np.zeros(bits // 8, np.uint8)
            for at in _bit_places(key[a:b].view(np.uint64), bits):
                np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    if now is not None:
        yield row()


def mapped(df: DataFrame, per_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow() over batches of bounded bytes, see lean_batches(), by workers that return their memory after each task."""
    lean_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from per_batches(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their task, and the next stage's heap stands beside theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):  # another C library has no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)


def lean_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that go to Python, unless the session has a bound: 10,000 long texts would go at once.

    Plans are run after the call that makes them, so the option stays set; every
    operator of this folder calls this before it uses Python.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, salts: int = 64, share: int = 10_000) -> DataFrame:
    """The inner join of left with right, whose keys are unique and whose column n counts the rows of each in left.

    A key with more than 1 / share of all total rows is hot. As counts add up to
    total at most, there are share hot keys at most: those are broadcast, and the
    rows of each are dealt to so many salts, so none of them lands in one task.
    """
    hot = right.where(F.col("n") > total / share)
    flags = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    dealt = left.join(flags, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.floor(F.rand(17) * salts).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("n") > total / share, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(every)), [*keys, "_salt"]).drop("_salt")


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about limit bytes of a string column, or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        first = size = 0
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > first and size + n > limit:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n
        if first < batch.num_rows:
            yield batch.slice(first)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that the links reach; linked nodes only.

    Alternates two star steps until nothing changes: every node tells its larger
    neighbours of the least one it sees, then its smaller ones. A step is a
    minimum (combined before its shuffle, so a node with very many links is
    harmless) and a join that adaptive execution can split. No link set is
    collected; each step is a written table, and the number of steps grows with
    the logarithm of the longest chain.
    """
    links = written(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "links")
    seen = None
    while True:
        # large star: from each node v, connect every larger neighbour to the least of v's neighbourhood
        both = links.select(F.col("lo").alias("v"), F.col("hi").alias("u")).unionByName(links.select(F.col("hi").alias("v"), F.col("lo").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("m").alias("lo"), F.col("u").alias("hi")).where("lo < hi").distinct()
        # small star: each node connects its smaller neighbours and itself to the least one
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")))).alias("e"))
        links = written(small.select("e.*").where("lo < hi").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = now
