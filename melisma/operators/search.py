"""Exact vector search: all query vectors against all rows in one scan, best k a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to every task, and scores that it holds of them: at most so many numbers. More queries than that are searched in blocks.
QUERY_NUMBERS = 8_000_000
#: Similarities that a task holds at once, and rows that it takes them of.
BLOCK_NUMBERS, BLOCK_ROWS = 2_000_000, 8192
#: Stands for a missing id.
NONE = np.iinfo(np.int64).min
#: Turns of interleaved sources that are put in order in one task.
TURNS = 1024


def ranked(scored: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    """The best k rows of each group and their rank. Spark keeps k rows a group and task before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, 9)


def _best(batches: Iterator[pa.RecordBatch], names: np.ndarray, q: np.ndarray, k: int, others: bool) -> Iterator[pa.RecordBatch]:
    """The best k rows of each query among all of a task's, in the order of ranks: what a task holds are k rows a query, and the similarities of one block of queries and rows."""
    n, d = q.shape
    top, held = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    edge = np.full(n, -np.inf)  # the least rounded score that is held, once there are k
    for whole in batches:
        for start in range(0, len(whole), BLOCK_ROWS):
            batch = whole.slice(start, BLOCK_ROWS)
            ids, column = batch.column(0).cast(pa.int64()), batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(0))
            ok = lengths == d  # rows of another length are unavailable
            if others:
                ok &= np.asarray(ids.is_valid())  # what has no id can't be told from a query
            ok = np.flatnonzero(ok)
            x = np.asarray(column.take(pa.array(ok)).flatten(), np.float64).reshape(-1, d)
            size = np.linalg.norm(x, axis=1)
            fine = (size > 0) & np.isfinite(size)
            ids, x = np.asarray(ids.fill_null(NONE))[ok[fine]], x[fine] / size[fine, None]
            step = max(1, BLOCK_NUMBERS // max(1, len(ids)))
            for a in range(0, n if len(ids) else 0, step):
                s = q[a : a + step] @ x.T
                low = edge[a : a + step]
                if k + others < len(ids) and not np.isfinite(low).all():  # one more than k, as the query itself may be among them
                    low = np.maximum(low, -np.partition(-s, k + others - 1, axis=1)[:, k + others - 1])
                i, j = np.nonzero(s >= (low - 1e-9)[:, None])
                score, those, i = s[i, j], ids[j], i + a
                # Of what is as good as the last one held, only the ids before its own.
                r = _rounded(score)
                some = (r > edge[i]) | (r == edge[i]) & (those < held[i, -1])
                if others:
                    some &= those != names[i]
                if some.any():
                    _merge(top, held, edge, i[some], score[some], those[some])
    step = max(1, BLOCK_ROWS // k)
    for a in range(0, n, step):
        i, j = np.nonzero(top[a : a + step] > -np.inf)
        if len(i):
            who, what = names[a + i], held[a + i, j]
            yield pa.RecordBatch.from_arrays([pa.array(who, mask=who == NONE), pa.array(what, mask=what == NONE), pa.array(top[a + i, j])], names=["query", "id", "score"])


def _merge(top: np.ndarray, held: np.ndarray, edge: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Puts scores and ids of queries i among what is held for them."""
    k = top.shape[1]
    own, at = np.unique(i, return_inverse=True)
    who = np.concatenate([np.repeat(np.arange(len(own)), k), at])
    s, ids = np.concatenate([top[own].ravel(), score]), np.concatenate([held[own].ravel(), ids])
    order = np.lexsort((ids, -_rounded(s), who))
    first = order[np.searchsorted(who[order], np.arange(len(own)))[:, None] + np.arange(k)]
    top[own], held[own] = s[first], ids[first]
    edge[own] = _rounded(top[own, -1])


def nearest(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(query, id, score, rank): for each query row (id, vector) the k rows of highest cosine, ties by id. Blocks of rows are multiplied with blocks of query vectors; each task gives its best k a query."""
    spark = rows.sparkSession
    n, d = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * max(d or 1, k) // QUERY_NUMBERS))
    out = None
    for b in range(blocks):
        some = F.exists("vector", lambda x: x != 0)
        if exclude_self:
            some &= F.col("id").isNotNull()
        got = queries.filter(some & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).orderBy("id").toArrow()
        q = np.asarray(got["vector"].combine_chunks().flatten(), np.float64).reshape(len(got), -1 if len(got) else 1)
        sent = spark.sparkContext.broadcast((np.asarray(got["id"].combine_chunks().fill_null(NONE)), q / np.linalg.norm(q, axis=1, keepdims=True)))
        found = rows.select("id", "vector").mapInArrow(lambda x, sent=sent: _best(x, *sent.value, k, exclude_self), "query long, id long, score double") if len(got) else spark.createDataFrame([], "query long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, ["query"], k, F.desc(F.round("score", 9)), F.col("id"))


def query_weights(representatives: DataFrame, group: str, key: str) -> DataFrame:
    """Representatives (group, key, weight) as query rows: weights of a group add up to 1, those without a positive weight are left out, and the heaviest (the first by key of equals) is primary."""
    w = Window.partitionBy(group)
    return representatives.filter("weight > 0").withColumn("is_primary", F.row_number().over(w.orderBy(F.desc("weight"), key)) == 1).withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def fused(evidence: DataFrame, constant: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion: of evidence (request, id, channel, query, rank, weight) the best a (channel, query) counts, and these add up; then divided by the request's greatest."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    best = evidence.groupBy("request", "id", "channel", "query").agg(F.max(w / (constant + F.col("rank"))).alias("x"))
    total = best.groupBy("request", "id").agg(F.sum("x").alias("fusion"))
    return total.withColumn("fusion", F.col("fusion") / F.max("fusion").over(Window.partitionBy("request")))


def interleaved(df: DataFrame, source: str, order: str, key: str) -> DataFrame:
    """Sources take turns, each in its own order; of rows with one key the first stays. Adds position (from 1)."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(order, key))
    dealt = df.withColumn("turn", turn).withColumn("first", F.row_number().over(Window.partitionBy(key).orderBy("turn", source)))
    # A position is the rows in earlier blocks of turns and the place in its own block, which has TURNS rows a source at most.
    kept = dealt.filter("first = 1").withColumn("block", F.floor((F.col("turn") - 1) / TURNS))
    sizes = kept.groupBy("block").agg(F.count(F.lit(1)).alias("there"))
    before = sizes.select("block", (F.sum("there").over(Window.orderBy("block")) - F.col("there")).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("turn", source))
    return kept.withColumn("place", place).join(before, "block").withColumn("position", F.col("before") + F.col("place")).drop("turn", "first", "block", "place", "before")
