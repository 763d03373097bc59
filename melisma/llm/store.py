"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Documents are long: Arrow batches of the usual 10,000 rows would hold tens of MB in several buffers of each task. A session that has set its own size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def column(name: str) -> Column:
    """A column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> DataFrame:
    """The rows of df as one struct called row, so that no column of theirs can clash with what an operator adds."""
    return df.select(F.struct(*map(column, df.columns)).alias("row"))


class Scratch:
    """Intermediate tables of one operator call. write() cuts the lineage: what it returns is read from files that outlive executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        short_batches(spark)
        self.spark, self.root = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
