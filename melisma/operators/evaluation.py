"""Offline evaluation: ranked-list metrics, temporal splits, playlist diagnostics, intervals, bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ranked_metrics(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(request, recall, ndcg) at k; null for a request without anything relevant. Of (request, id, rank) and (request, id, gain)."""
    hits = ranked.filter(F.col("rank") <= k).dropDuplicates(["request", "id"]).join(relevance, ["request", "id"]).groupBy("request").agg(F.count(F.when(F.col("gain") > 0, 1)).alias("hits"), F.sum((F.pow(2.0, "gain") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = relevance.filter("gain > 0").withColumn("r", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("gain"), "id")))
    ideal = best.groupBy("request").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, (F.pow(2.0, "gain") - 1) / F.log2(F.col("r") + 1))).alias("idcg"))
    requests = ranked.select("request").distinct().join(ideal, "request", "left").join(hits, "request", "left")
    return requests.select("request", F.when(F.col("relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"), F.when(F.col("relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def temporal_split(cases: DataFrame, at: str, parts: tuple[float, ...] = (0.6, 0.2)) -> DataFrame:
    """Adds split (train, validation, test) by time; cases of one time stay together, in the earlier part. Cases are counted by time first, so the running sum goes over distinct times."""
    c = cases.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    upto = c.withColumn("before", F.sum("n").over(Window.orderBy(at)) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    a, b = parts
    split = F.when(F.col("before") < F.floor(F.col("all") * a), "train").when(F.col("before") < F.floor(F.col("all") * (a + b)), "validation").otherwise("test")
    return cases.join(upto.select(at, split.alias("split")), at)


def interval(x: Column) -> tuple[Column, Column]:
    """Mean less and plus 1.96 standard errors; the mean itself for one sample."""
    half = F.coalesce(1.96 * F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))
    return F.avg(x) - half, F.avg(x) + half


def binomial_upper(failures: int, n: int, level: float = 0.95) -> float:
    """The exact one-sided upper bound of a failure rate (Clopper-Pearson), by bisection of the binomial tail."""
    if not 0 <= failures <= n or n <= 0:
        raise ValueError("0 <= failures <= n, n > 0")
    if failures == n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(failures + 1)]
    lo, hi = 0.0, 1.0
    for _ in range(80):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if 0 < p < 1 else float(p == 0)
        lo, hi = (p, hi) if tail > 1 - level else (lo, p)
    return (lo + hi) / 2


def binomial_upper_column(failures: Column, n: Column) -> Column:
    """The bound by groups: a row a group, so few rows come here."""
    return F.pandas_udf(lambda f, m: pd.Series([binomial_upper(int(a), int(b)) for a, b in zip(f, m, strict=True)]), DoubleType())(failures, n)


def bootstrap(rows: pd.DataFrame, samples: int = 2000, seed: int = 1) -> pd.DataFrame:
    """The 95 % interval of the mean of cluster differences, resampled by cluster."""
    d = rows.sort_values("cluster")["delta"].to_numpy(float)
    rng = np.random.Generator(np.random.PCG64(seed))
    means = d[rng.integers(0, len(d), (samples, len(d)))].mean(1)
    return pd.DataFrame([(rows["variant"].iloc[0], float(d.mean()), float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)))], columns=["variant", "mean", "low", "high"])


def gate(good: Column, total: Column, target: float, least: int = 20) -> Column:
    return F.when(total < least, "insufficient").when(good / total >= target, "pass").otherwise("fail")


def intent_scores(runs: DataFrame) -> DataFrame:
    """Of runs (phase, case, latency, valid, checks: array of (field, ok)): for each phase its runs, the share with a valid schema, the share of labelled fields that are right (none of a run that failed), and the latencies at the middle and at 95 %, by nearest rank."""
    right = F.size(F.filter("checks", lambda c: c["ok"])).cast("long")
    per = runs.select("phase", "valid", "latency", F.size("checks").cast("long").alias("fields"), F.when(F.col("valid"), right).otherwise(0).alias("right"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)")
    return per.groupBy("phase").agg(
        F.count(F.lit(1)).alias("runs"), (F.sum(F.col("valid").cast("long")) / F.count(F.lit(1))).alias("schema_rate"), F.when(F.sum("fields") > 0, F.sum("right") / F.sum("fields")).alias("field_accuracy"), at(0.5).alias("p50"), at(0.95).alias("p95"),
    )
