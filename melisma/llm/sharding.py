"""Feistel sharding: a keyed permutation of global row numbers deals rows into shards.

Global row numbers need no global sort in one place and no sampling: rows are ordered by (hash, id, size, crc32), the hash's
leading bits cut them into ranges of near equal size, and a range's first number is the sum of the counts before it.
What is numbered are the distinct (id, size, crc32) with their counts; rows get their numbers by a join, and rows that are equal in these
take turns by where they lie in the input, so that one repeated very often is numbered in as many places as it is read in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .store import Scratch, tables, whole

SHARDS, SEED, ROUNDS, RANGE_ROWS = 16, 20240601, 6, 200_000


def feistel(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1. The network permutes 0..4**h-1, the least such domain; numbers that leave 0..n-1 are walked on until they return."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 62, rounds).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            y = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((y >> np.uint64(33)) & mask)
        return (left << h) | right

    out = once(np.asarray(numbers, np.uint64))
    while (away := out >= np.uint64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def shard(df: DataFrame, id_col: str, text_col: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """row (a row of df, whole), law, shard, slot and grown_shard for every row.

    Null ids are rows like others. Rows that are equal in id, size and crc32 of their texts (a null text is empty) each get a slot, no matter which of them gets which. An empty table
    gives no rows. The law is `rows`: shard = permuted row number modulo `shards`, slot = the quotient.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = whole(df).select("row", F.struct(F.col("row")[id_col].alias("id"), F.octet_length(text).alias("size"), F.crc32(text.cast("binary")).alias("crc")).alias("key"))
    # Where a row lies is taken before any shuffle, by which equal rows meet.
    rows = rows.withColumns({"h": F.xxhash64(F.lit(seed), "key"), "at": F.spark_partition_id(), "nth": F.monotonically_increasing_id()})
    counted = rows.groupBy("h", "key").agg(F.count(F.lit(1)).alias("copies"))
    n = df.count()
    bits = max(0, (n // RANGE_ROWS).bit_length())
    ranged = counted.withColumn("range", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    in_order = Window.partitionBy("range").orderBy("h", "key")
    numbered = ranged.withColumn("upto", F.sum("copies").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    # One row a range: 2**bits rows at most, 1 for each RANGE_ROWS rows of the input.
    starts = ranged.groupBy("range").agg(F.sum("copies").alias("there"))
    starts = starts.select("range", (F.sum("there").over(Window.orderBy("range")) - F.col("there")).alias("before"))
    numbered = scratch.write(numbered.join(starts, "range").select("h", "key", "copies", (F.col("before") + F.col("upto")).alias("first")), "numbers")
    placed = rows.join(numbered, ["h", "key"])
    out = placed.filter("copies = 1").select("row", F.col("first").alias("number"))
    if numbered.filter("copies > 1").limit(1).count():
        again = scratch.write(placed.filter("copies > 1").select("row", "h", "key", "first", "at", "nth"), "repeated")
        there = again.groupBy("h", "key", "at").agg(F.count(F.lit(1)).alias("there"))
        there = there.select("h", "key", "at", (F.sum("there").over(Window.partitionBy("h", "key").orderBy("at")) - F.col("there")).alias("before"))
        turn = F.row_number().over(Window.partitionBy("h", "key", "at").orderBy("nth")) - 1
        again = again.withColumn("turn", turn).join(there, ["h", "key", "at"]).select("row", (F.col("first") + F.col("before") + F.col("turn")).alias("number"))
        out = out.unionByName(again)
    permute = F.pandas_udf(lambda x: pd.Series(feistel(x.to_numpy(), n, seed)), LongType())
    return out.withColumn("p", permute("number")).select(
        "row", F.lit("rows").alias("law"), F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("p") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(tables(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    text = F.coalesce("row.text", F.lit(""))
    return dealt.select("row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")
