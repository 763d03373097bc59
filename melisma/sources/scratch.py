"""The shared folder for tables between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session without one is given its own: a temporary folder on one machine, a folder in the warehouse, which executors share, on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        named = "file://" + tempfile.mkdtemp(prefix="melisma-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_between"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a round's table to the shared folder and reads it back: lineage ends there, and what was computed outlives executors."""
    root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def kept(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{root}/{part}")
        return spark.read.schema(df.schema).parquet(f"{root}/{part}")

    return kept
