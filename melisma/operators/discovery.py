"""Candidates from several places: channels with budgets, and discovery in batches until enough are accepted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keeper


def budgeted(channels: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """request, id, channel, turn, spilled and provenance, from channels (name, rows of request, id and score, budget).

    A candidate that several channels have belongs to the one that ranks it highest (the earlier one of equals), and keeps what each of them said of it. Each channel gives its best up to its budget. What
    channels could not use goes to the others in turns: to each one's first candidate beyond its budget, then to each one's second, in the order of the plan.
    """
    every = reduce(DataFrame.unionByName, (df.select("request", "id", "score").withColumns({"channel": F.lit(name), "place": F.lit(k), "budget": F.lit(budget).cast("long")}) for k, (name, df, budget) in enumerate(channels)))
    # A channel that names a candidate twice means its best score.
    every = every.groupBy("request", "id", "channel", "place", "budget").agg(F.max("score").alias("score"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("request", "place").orderBy(F.desc("score"), "id")))
    one = ranked.groupBy("request", "id").agg(F.min(F.struct("rank", "place", "channel", "budget")).alias("own"), F.sort_array(F.collect_list(F.struct("place", "channel", "rank", "score"))).alias("said"))
    # Written once: three steps read it, and none of them should search again.
    keep = keeper(channels[0][1].sparkSession, "budgeted")
    own = one.select("request", "id", "own.channel", "own.place", "own.budget", F.row_number().over(Window.partitionBy("request", "own.place").orderBy("own.rank", "id")).alias("turn"), F.transform("said", lambda x: F.struct(x["channel"].alias("channel"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("provenance"))
    own = keep(own, "own")
    total = sum(b for *_, b in channels)
    used = own.groupBy("request").agg(F.count(F.when(F.col("turn") <= F.col("budget"), 1)).alias("used"))
    over = F.col("turn") > F.col("budget")
    spill = own.filter(over).withColumn("nth", F.row_number().over(Window.partitionBy("request").orderBy(F.col("turn") - F.col("budget"), "place"))).join(used, "request").filter(F.col("nth") <= F.lit(total) - F.col("used"))
    columns = ["request", "id", "channel", "turn", "provenance"]
    return own.filter(~over).select(*columns, F.lit(False).alias("spilled")).unionByName(spill.select(*columns, F.lit(True).alias("spilled")))


def invalid_provenance(found: DataFrame, channels: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """The rows of budgeted() whose provenance a channel doesn't back: an empty one, one of an unknown channel, or a score that the channel never gave."""
    given = reduce(DataFrame.unionByName, (df.select("request", "id", F.round("score", 9).alias("score"), F.lit(name).alias("channel")) for name, df, _ in channels)).distinct().withColumn("backed", F.lit(True))
    said = found.select("request", "id", F.explode_outer("provenance").alias("p")).select("request", "id", F.col("p.channel").alias("channel"), F.round("p.score", 9).alias("score"))
    return said.join(given, ["request", "id", "channel", "score"], "left").filter("backed is null").select("request", "id", "channel")


def discover(sources: list[DataFrame], accept: Callable[[DataFrame], DataFrame], wanted: int, batch: int, growth: int = 2, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, attempted, outcomes): candidates in batches, until each request has `wanted` accepted ones.

    sources: rows (request, id, rank), one table behind the other; a source is asked once those before it have nothing left for a request. accept gives of candidates (request, id, ...) those that pass; it sees no candidate twice, and
    none of a request that has enough. Attempted ids are a table that grows, never a list on the driver. Batches grow by `growth` from round to round, so that rounds stay few. A request ends as `fulfilled`, as
    `limited` after `most` attempts, or as `partial` when all sources are exhausted.
    """
    spark = sources[0].sparkSession
    keep = keeper(spark, "discovery")
    stream = reduce(DataFrame.unionByName, (s.select("request", "id", "rank").withColumn("source", F.lit(k)) for k, s in enumerate(sources)))
    # Of a candidate of several sources, or named twice, the first place counts.
    stream = stream.groupBy("request", "id").agg(F.min(F.struct("source", "rank")).alias("at"))
    stream = keep(stream.select("request", "id", "at.source", "at.rank", F.row_number().over(Window.partitionBy("request").orderBy("at.source", "at.rank", "id")).alias("turn")), "stream")
    need = keep(stream.groupBy("request").agg(F.max("turn").alias("there")).select("request", "there", F.lit(0).cast("long").alias("tried"), F.lit(0).cast("long").alias("got")), "need0")
    attempted = accepted = None
    size, k = batch, 0
    limit = F.col("there") if most is None else F.least(F.col("there"), F.lit(most))
    while True:
        k += 1
        going = need.filter((F.col("got") < wanted) & (F.col("tried") < limit))
        if not going.limit(1).count():
            break
        turn = stream.join(going.select("request", "tried", limit.alias("limit")), "request").filter((F.col("turn") > F.col("tried")) & (F.col("turn") <= F.least(F.col("tried") + size, F.col("limit")))).select("request", "id", "source", "rank", "turn")
        turn = keep(turn.withColumn("round", F.lit(k)), f"tried{k}")
        good = keep(accept(turn).select("request", "id", "turn"), f"good{k}")
        attempted = turn if attempted is None else attempted.unionByName(turn)
        accepted = good if accepted is None else accepted.unionByName(good)
        had = turn.groupBy("request").agg(F.count(F.lit(1)).alias("t")).join(good.groupBy("request").agg(F.count(F.lit(1)).alias("g")), "request", "left")
        need = keep(need.join(had, "request", "left").select("request", "there", (F.col("tried") + F.coalesce("t", F.lit(0))).alias("tried"), (F.col("got") + F.coalesce("g", F.lit(0))).alias("got")), f"need{k}")
        size *= growth
    if attempted is None:
        attempted, accepted = stream.limit(0).withColumn("round", F.lit(0)), stream.limit(0).select("request", "id", "turn")
    first = accepted.withColumn("position", F.row_number().over(Window.partitionBy("request").orderBy("turn"))).filter(F.col("position") <= wanted)
    outcome = F.when(F.col("got") >= wanted, "fulfilled").when(F.col("tried") < F.col("there"), "limited").otherwise("partial")
    return first.select("request", "position", "id"), attempted, need.select("request", F.col("tried").alias("attempts"), F.least("got", F.lit(wanted).cast("long")).alias("accepted"), outcome.alias("outcome"))
