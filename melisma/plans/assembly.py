"""Queries of playlist assembly. A request's pool is the 64 nearest vectors of a seed; length comes from the id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..sources.tables import vectors
from .registry import query
from .vectors import hits


def pool(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", F.col("artist").cast("string").alias("artist"), F.col("audio").alias("vector"))
    h = hits(spark, d, 64).select(F.col("query").alias("request"), "id", F.round("score", 9).alias("total"))
    i = F.col("id")
    return h.join(v, "id").withColumns({"album": F.when(i % 4 != 0, F.concat_ws("/", "artist", (i % 3).cast("string"))), "title": (i % 97).cast("string"), "ms": F.when(i % 9 != 0, 150_000 + i * 7919 % 200_000)})


@query("mmr_select")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return A.per_request(pool(spark, d), lambda rows: A.select(rows, 20))


@query("sequence_greedy")
def sequence_greedy(spark: SparkSession, d: str) -> DataFrame:
    return A.per_request(pool(spark, d), lambda rows: _after_selection(rows, lambda x: A.sequence(x)))


def _after_selection(rows: pd.DataFrame, order) -> list[int]:
    kept = A.select(rows, 20)
    return [kept[i] for i in order(rows.iloc[kept].reset_index(drop=True))]


@query("duration_fit")
def duration_fit(spark: SparkSession, d: str) -> DataFrame:
    """An hour, give or take a minute."""

    def choose(rows: pd.DataFrame) -> list[int]:
        ms = [None if pd.isna(v) else int(v) for v in rows["ms"]]
        return A.fit_duration(A.select(rows, 20), A.select(rows, 64), ms, list(zip(rows["artist"], rows["title"], strict=True)), 3_600_000, 60_000)

    return A.per_request(pool(spark, d), choose)


@query("genre_cover")
def genre_cover(spark: SparkSession, d: str) -> DataFrame:
    return A.per_request(pool(spark, d), lambda rows: A.cover([{int(i) % 7, 7 + int(i) % 5} for i in rows["id"]], set(range(12)), 12))


@query("journey_beam")
def journey_beam(spark: SparkSession, d: str) -> DataFrame:
    def choose(rows: pd.DataFrame) -> list[int]:
        kept = A.select(rows, 12)
        x, _ = A.unit(rows["vector"].iloc[kept])
        return [kept[i] for i in A.beam([[int(rows["id"][k]) % 3 == s for s in range(3)] for k in kept], x, 3)]

    return A.per_request(pool(spark, d), choose)


@query("journey_sequence")
def journey_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Along a path from the best candidate to the least."""

    def choose(rows: pd.DataFrame) -> list[int]:
        def order(x: pd.DataFrame) -> list[int]:
            u, _ = A.unit(x["vector"])
            return A.sequence(x, target=u[[0, len(u) - 1]])

        return _after_selection(rows, order)

    return A.per_request(pool(spark, d), choose)


@query("baseline_walk")
def baseline_walk(spark: SparkSession, d: str) -> DataFrame:
    def choose(rows: pd.DataFrame) -> list[int]:
        u, _ = A.unit(rows["vector"])
        return A.walk(rows, u[int(np.argmax(rows["total"].to_numpy()))], 15)

    return A.per_request(pool(spark, d), choose)


@query("stage_order_violations", """WITH s AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query, vec_id AS id, list_cosine_similarity(q, embedding::DOUBLE[]) AS sc FROM s, embeddings WHERE vec_id <> query),
k AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(sc, 9) DESC, id) AS r FROM x QUALIFY r <= 30),
c AS (SELECT query, i, j, sum((id % 3 <> CASE WHEN r <= i THEN 0 WHEN r <= j THEN 1 ELSE 2 END)::INT) AS bad FROM k, range(0, 31) a(i), range(0, 31) b(j) WHERE i <= j GROUP BY ALL)
SELECT query AS request, min(bad)::BIGINT AS violations FROM c GROUP BY query""")
def stage_order_violations(spark: SparkSession, d: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows.sort_values(["total", "id"], ascending=[False, True])["id"].head(30)
        return pd.DataFrame([(rows["request"].iloc[0], A.stage_violations([[int(i) % 3 == s for s in range(3)] for i in ids], 3))], columns=["request", "violations"])

    return A.capped(pool(spark, d)).groupBy("request").applyInPandas(run, "request long, violations long")


@query("pool_outcome", """WITH s AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query, vec_id AS id, list_cosine_similarity(q, embedding::DOUBLE[]) AS sc FROM s, embeddings WHERE vec_id <> query), t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sc, 9) DESC, id) <= 64)
SELECT query AS request, count(*) AS candidates, CASE WHEN count(*) FILTER (sc >= 0.2) >= 20 THEN 'fulfilled' WHEN count(*) FILTER (sc >= 0.2) > 0 THEN 'partial' ELSE 'unsupported' END AS outcome FROM t GROUP BY query""")
def pool_outcome(spark: SparkSession, d: str) -> DataFrame:
    good = F.count(F.when(F.col("total") >= 0.2, 1))
    return pool(spark, d).groupBy("request").agg(F.count(F.lit(1)).alias("candidates"), F.when(good >= 20, "fulfilled").when(good > 0, "partial").otherwise("unsupported").alias("outcome"))


@query("stage_reservation", """WITH s AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query, vec_id AS id, list_cosine_similarity(q, embedding::DOUBLE[]) AS sc FROM s, embeddings WHERE vec_id <> query), t AS (SELECT query, id, round(sc, 9) AS sc FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sc, 9) DESC, id) <= 64),
f AS (SELECT *, greatest(0.1, max(sc) OVER (PARTITION BY query) - 0.15) AS floor FROM t)
SELECT query AS request, (id % 3)::INTEGER AS stage, id FROM f WHERE sc >= floor QUALIFY row_number() OVER (PARTITION BY query, id % 3 ORDER BY sc DESC, id) = 1""")
def stage_reservation(spark: SparkSession, d: str) -> DataFrame:
    """One sufficiently relevant candidate for each stage of a journey, before diversity chooses the rest. The pool is bounded, so a request is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["total", "id"], ascending=[False, True]).reset_index(drop=True)
        got = A.reserve(rows["total"].tolist(), [[int(i) % 3 == s for s in range(3)] for i in rows["id"]], 0.1, 0.15)
        return pd.DataFrame([(rows["request"].iloc[0], s, rows["id"].iloc[i]) for s, i in enumerate(got) if i is not None], columns=["request", "stage", "id"])

    return A.capped(pool(spark, d)).groupBy("request").applyInPandas(run, "request long, stage int, id long")


@query("spacing_repair")
def spacing_repair(spark: SparkSession, d: str) -> DataFrame:
    """The twelve picks in an order without neighbours of one artist, if backtracking finds one."""

    def choose(rows: pd.DataFrame) -> list[int]:
        kept = A.select(rows, 12)
        return A.repair([set(kept)] * len(kept), kept, rows["artist"].tolist()) or kept

    return A.per_request(pool(spark, d), choose)


@query("playlists_with_reasons")
def playlists_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    return A.playlists(pool(spark, d), 20)
