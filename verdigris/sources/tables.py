"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the cluster's spark.checkpoint.dir; only where that is unset, as in tests, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends there, and what a loop builds on it isn't computed again."""
    path = f"{shared_folder(df.sparkSession, 'tables')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes after which a batch of rows for Python is closed.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at once by bytes, unless the session has a bound: a batch is else 10,000 rows, of texts of any length.

    Plans run after the call that makes them, so the option stays set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)
