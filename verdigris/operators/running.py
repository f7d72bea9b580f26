"""Running sums and maxima of a key, however many rows it has.

A window over a key is one task. Here rows are dealt to ranges of the key and the
order, each range keeps its own running value of a key, and what the ranges before
it have come to is carried in: a row for each key and range. A key with a third of
all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.sources.tables import kept


def running(rows: DataFrame, key: str, order: list[str], value: str, how: str = "sum", name: str = "running") -> DataFrame:
    """rows with name: the sum or max of value up to and with each row of its key, by order; rows equal in it go in any order.

    Nulls in value don't count (a sum of nothing is 0, a max null); a null key is a
    key. Ranges are a written table before anything is summed, so a lost executor
    can't deal a row anew.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    held = kept(rows.withColumn("_number", F.monotonically_increasing_id()), "running_rows")
    parts = kept(held.repartitionByRange(key, *order, "_number").withColumn("_part", F.spark_partition_id()), "running_parts")
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.groupBy(key, "_part").agg(fold(value).alias("_own")).withColumn("_carried", fold("_own").over(before)).select(F.col(key).alias("_key"), F.col("_part").alias("_of"), "_carried")
    local = fold(value).over(W.partitionBy(key, "_part").orderBy(*order, "_number").rowsBetween(W.unboundedPreceding, 0))
    met = parts.withColumn("_local", local).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    both = F.coalesce("_carried", F.lit(0)) + F.coalesce("_local", F.lit(0)) if how == "sum" else F.greatest("_carried", "_local")
    return met.withColumn(name, both).select(*(c for c in rows.columns if c != name), name)
