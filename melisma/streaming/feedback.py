"""The feedback log as a stream: idempotent append, last-write-wins state, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.taste import DIRECT

def once(events: DataFrame, late: str = "35 days") -> DataFrame:
    """Each event once, however often it is appended; ids are remembered as long as events may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def preferences(events: DataFrame) -> DataFrame:
    """Streaming last-write-wins by (listener, track): rows of sequence, listener, track, kind, weight in, the current preference out after every change.

    An aggregate that Spark keeps as its state: of each slot what was said last, whenever it comes. Exposures, and events without a listener or track, are no preferences and take no state.
    """
    direct = F.col("kind").isin(*DIRECT)
    last = lambda slot: F.max_by(F.struct("kind", "weight"), F.when(slot, F.col("sequence")))
    said = events.filter((F.col("kind") != "exposure") & F.col("listener").isNotNull() & F.col("track").isNotNull())
    now = said.groupBy("listener", "track").agg(last(direct).alias("direct"), last(~direct).alias("review"))
    return now.select("listener", "track", *(F.col(s)[c].alias(f"{s}_{c}") for s in ("direct", "review") for c in ("kind", "weight")))


def activity(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by kind in windows of event time; windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


#: Parts of an upserted table. A batch rewrites only those that its keys fall into.
PARTS = 256


def upsert(batch: DataFrame, path: str, key: list[str], order: str, parts: int = PARTS) -> None:
    """For foreachBatch: merges a batch into a Parquet table, the last row of each key winning.

    Rows lie in parts by their key's hash. The parts that a batch touches are written anew beside the old ones, then a list of which version of each part holds, so that
    readers see a batch whole or not at all, and a repeated batch changes nothing. A table keeps the number of parts it began with.
    """
    from ..operators.catalog import latest

    spark = batch.sparkSession
    try:
        number = _version(spark, f"{path}/lists")
        held = {r.part: (r.version, r.parts) for r in spark.read.parquet(f"{path}/lists/{number}").collect()}  # at most one row a part
    except FileNotFoundError:
        number, held = -1, {}
    parts = next((n for _, n in held.values()), parts)
    rows = batch.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    touched = [r[0] for r in rows.select("_part").distinct().collect()]
    if not touched:
        return
    old = [f"{path}/rows/{held[p][0]}/_part={p}" for p in touched if p in held]
    if old:
        rows = spark.read.schema(batch.schema).parquet(*old).select(*batch.columns).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).unionByName(rows)
    latest(rows, ["_part", *key], F.desc(order)).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows/{number + 1}")
    held |= {p: (number + 1, parts) for p in touched}
    spark.createDataFrame([(p, v, n) for p, (v, n) in sorted(held.items())], "part int, version int, parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/{number + 1}")


def _version(spark, path: str) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    done = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(p) else []
    if not done:
        raise FileNotFoundError(path)
    return max(done)


def current(spark, path: str) -> DataFrame:
    """The table as of its last whole batch."""
    held = spark.read.parquet(f"{path}/lists/{_version(spark, f'{path}/lists')}").collect()
    return spark.read.parquet(*(f"{path}/rows/{r.version}/_part={r.part}" for r in held))
