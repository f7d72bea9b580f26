"""A session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, name: str = "verdigris", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster, spark-submit sets these.

    UTC is needed for equal dates on every machine. Adaptive execution merges
    small shuffle partitions and splits skewed joins.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
