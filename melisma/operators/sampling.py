"""Weighted samples that can be merged: every row has a priority by its key alone, and a sample is the rows of least priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(key: Column, weight: Column, seed: int) -> Column:
    """Exponential of rate weight, decided by key and seed: of rows of weights v and w the first comes earlier with chance v / (v + w). Rows without a positive weight have none."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.when(weight > 0, -F.log(u) / weight)


def bottom_k(df: DataFrame, key: str, weight: str, k: int, seed: int = 0, by: list[str] = ()) -> DataFrame:
    """The k + 1 rows of least priority of each group of `by` (ties by key), with `priority`; of rows of one key the heaviest counts. The last of them is there for its priority, from which the others' weights follow."""
    rows = df.withColumn("priority", F.round(priority(F.col(key), F.col(weight), seed), 15)).filter("priority is not null")
    one = F.row_number().over(Window.partitionBy(*by, key).orderBy(F.desc(weight)))
    rows = rows.withColumn("_one", one).filter("_one = 1").drop("_one")
    if not by:
        # Each task keeps its own least ones; they meet in one place, k + 1 a task at most.
        return rows.orderBy("priority", key).limit(k + 1)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("priority", key))).filter(F.col("_n") <= k + 1).drop("_n")


def merged(samples: list[DataFrame], key: str, weight: str, k: int) -> DataFrame:
    """The sample of all that the samples are of: a row among the k + 1 least of the whole is among those of its part. Samples need one seed and at least this k; of a key in several the heaviest row, which comes first, counts."""
    every = reduce(DataFrame.unionByName, samples)
    one = F.row_number().over(Window.partitionBy(key).orderBy("priority", F.desc(weight)))
    return every.withColumn("_one", one).filter("_one = 1").drop("_one").orderBy("priority", key).limit(k + 1)


def weighted(sample: DataFrame, key: str, weight: str, k: int) -> DataFrame:
    """The k rows of a sample with what each stands for: 1 / (its chance to be in it). A sample of everything stands for itself."""
    last = sample.withColumn("_n", F.row_number().over(Window.orderBy("priority", key)))  # k + 1 rows at most
    edge = last.filter(F.col("_n") == k + 1).select(F.col("priority").alias("_edge"))
    with_edge = last.filter(F.col("_n") <= k).join(edge, F.lit(True), "left")  # one row at most
    stands = F.when(F.col("_edge").isNull(), F.lit(1.0)).otherwise(1 / (1 - F.exp(-F.col(weight) * F.col("_edge"))))
    return with_edge.withColumn("stands_for", stands).drop("_n", "_edge")
