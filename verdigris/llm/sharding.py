"""Sharding by jump consistent hashing.

A key seeds a linear congruential generator whose draws tell the shard counts at
which it jumps: each jump goes to the last shard of such a count, and the last jump
below the stated count is the key's shard. There is no table of ring points. When
shards are appended, a key stays or jumps to one of the new ones, so only their
share of the rows moves. All of it is column expressions.

Rows get gapless slots in their shard without a window over a whole shard: the
digest columns are range partitioned once, each partition numbers its own rows of a
shard, and prefix sums of the partitions' counts tell where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.shared import named, written

#: Shards of the query, and what a row takes beside its text.
SHARDS, ROW_BYTES = 24, 8
#: The generator's factor (its increment is 1): fixed values of the published algorithm, which other implementations share.
FACTOR = 2862933555777941757
#: Jumps that are looked for first; a key has about ln(shards) of them. Whoever has more goes on to the end.
FIRST_JUMPS = 48
_LOW32, _LOW16 = (1 << 32) - 1, (1 << 16) - 1


def _next(key: Column) -> Column:
    """key * FACTOR + 1 modulo 2**64, by limbs: no product or sum leaves a long, so ANSI mode has nothing to refuse."""
    low, high = key.bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(key, 32)
    f0, f1, f2 = FACTOR & _LOW16, FACTOR >> 16 & _LOW16, FACTOR >> 32
    ones, mids = low * F.lit(f0) + 1, low * F.lit(f1)
    lower = ones + F.shiftleft(mids.bitwiseAND(F.lit(_LOW16)), 16)
    upper = F.shiftrightunsigned(lower, 32) + F.shiftrightunsigned(mids, 16) + (low * F.lit(f2)).bitwiseAND(F.lit(_LOW32)) + high * F.lit(f0) + F.shiftleft((high * F.lit(f1)).bitwiseAND(F.lit(_LOW16)), 16)
    return F.shiftleft(upper, 32).bitwiseOR(lower.bitwiseAND(F.lit(_LOW32)))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard in [0, shards) of a long key; null for a null key."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def jump(at: Column, _: Column) -> Column:
        key = _next(at["key"])
        share = F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + 1).cast("double")
        to = F.floor((at["to"] + 1).cast("double") * share)
        return F.when(at["to"] < shards, F.struct(key.alias("key"), at["to"].alias("last"), to.alias("to"))).otherwise(at)

    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("to"))
    # to rises with each jump, so shards jumps are enough for any key.
    some = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_JUMPS))), start, jump, lambda at: at)
    if shards <= FIRST_JUMPS:
        return F.when(key.isNotNull(), some["last"]).cast("int")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), some, jump, lambda at: at["last"])
    return F.when(key.isNotNull(), F.when(some["to"] >= shards, some["last"]).otherwise(rest)).cast("int")


def key_of(docs: DataFrame, id_col: str) -> Column:
    """The long that stands for an id: itself if it is an integer, else the hash of its text; a null id counts as 0."""
    kind = dict(docs.dtypes)[id_col]
    key = named(id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(named(id_col).cast("string"))
    return F.when(named(id_col).isNull(), F.lit(0).cast("long")).otherwise(key)


def with_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the column name (replaced if there is one): the shard of each row by its id; no row is moved."""
    return docs.withColumn(name, jump_shard(key_of(docs, id_col), shards))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", files: int = 1) -> None:
    """Write docs as Parquet, a folder shard=N for each shard, in about so many files each.

    A file's rows are dealt by hash of the id and the row's place in its input
    partition, so that rows which repeat an id don't fill one file.
    """
    part = F.pmod(F.xxhash64(named(id_col), F.monotonically_increasing_id()), F.lit(files))
    dealt = with_shards(docs, shards, id_col).withColumn("_file", part).repartition(shards * files, "shard", "_file")
    dealt.drop("_file").write.partitionBy("shard").parquet(path)


def with_slots(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with slot: 0, 1, ... in each group, by the columns of order; rows that are equal in them go in any order.

    The last key of the ranges is the row's number, so rows that repeat all of
    order are parted too. Partitions are written before they are counted: a lost
    executor can't change who is in one.
    """
    held = written(rows.withColumn("_number", F.monotonically_increasing_id()), "shard_rows")
    parts = written(held.repartitionByRange(*order, "_number").withColumn("_part", F.spark_partition_id()), "shard_parts")
    ahead = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order, "_number"))
    return parts.withColumn("_own", own).join(counts, [group, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_own") - 1).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs.

    The law is "key": the id and the number of shards decide. size is the text's
    bytes in UTF-8 and ROW_BYTES; grown_shard is the shard with one more of them.
    A null text has no bytes and the checksum of none, like an empty one; texts
    are read whole whatever their length. Rows that repeat an id go to one shard,
    in slots of their own; a null id goes where id 0 goes. Slots follow the id
    (nulls first), then checksum and size. An empty table gives no rows. Other
    columns aren't read.
    """
    text = named(text_col).cast("string")
    key = key_of(docs, id_col)
    rows = docs.select(
        named(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["_id", "text_crc32", "size"]).select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _jump_sql(shards: int) -> str:
    """jumps(doc_id, key, last, upto) of a recursive query: a row for each jump of each key."""
    return f"""
  SELECT doc_id, key, last, upto FROM (
    SELECT doc_id, (k * {FACTOR}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS key, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS upto
    FROM (SELECT DISTINCT coalesce(doc_id, 0) AS doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END AS k FROM documents))
  UNION ALL
  SELECT doc_id, (key * {FACTOR}::HUGEINT + 1) % 18446744073709551616::HUGEINT, upto, CAST(floor((upto + 1)::DOUBLE * (2147483648::DOUBLE / (key // 8589934592 + 1)::DOUBLE)) AS BIGINT)
  FROM {{name}} WHERE upto < {shards}"""


def _crc_step(c: int, bits: int) -> int:
    """The checksum's register after so many zero bits."""
    for _ in range(bits):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: The checksum goes by half bytes, the lower one first, through a table of 16 entries; all texts take a step at once.
OP13_SQL = f"""
WITH RECURSIVE
now AS ({_jump_sql(SHARDS).format(name="now")}),
grown AS ({_jump_sql(SHARDS + 1).format(name="grown")}),
shards AS (SELECT doc_id, max(last) AS shard FROM now GROUP BY doc_id),
more AS (SELECT doc_id, max(last) AS shard FROM grown GROUP BY doc_id),
halves AS (SELECT text, list_transform(range(octet_length(encode(text)) * 2), lambda i: CAST(instr('123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) AS BIGINT)) AS v
  FROM (SELECT DISTINCT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents)),
sums AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, v), lambda c, b: xor(c >> 4, {[_crc_step(c, 4) for c in range(16)]}[(xor(c, b) & 15) + 1]))) AS crc FROM halves)
SELECT d.doc_id, octet_length(encode(coalesce(d.text, ''))) + {ROW_BYTES} AS size, sums.crc AS text_crc32, 'key' AS law, CAST(s.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY d.doc_id NULLS FIRST, sums.crc, octet_length(encode(coalesce(d.text, '')))) - 1 AS slot, CAST(m.shard AS INTEGER) AS grown_shard
FROM documents d JOIN shards s ON s.doc_id = coalesce(d.doc_id, 0) JOIN more m ON m.doc_id = coalesce(d.doc_id, 0) JOIN sums ON sums.text = coalesce(d.text, '')
"""
