"""Taste profiles from an append-only feedback log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import keeper
from . import search

#: Similarities that a task holds at once: at most so many numbers.
BLOCK_NUMBERS = 2_000_000
#: Pairs of listeners and rows that a task gives.
TASK_PAIRS = 8_000_000

DAY = 86_400
LONG_HALF_LIFE, SHORT_HALF_LIFE, LEAST_EXPOSURE, MOST_EXPOSURES = 30 * DAY, 7 * DAY, 0.01, 2048
#: Preferences that replace each other; a review (accept, remove) is a slot of its own.
DIRECT = ("like", "dislike", "more_like", "less_like")


def effective(events: DataFrame) -> DataFrame:
    """What holds of (listener, track): the last direct preference and the last review; exposures don't count. Events: sequence, listener, track, kind, weight, said."""
    slot = F.when(F.col("kind").isin(*DIRECT), "direct").when(F.col("kind") != "exposure", "review")
    e = events.withColumn("slot", slot).filter("slot is not null")
    last = e.groupBy("listener", "track", "slot").agg(F.max_by(F.struct("kind", "weight", "said"), "sequence").alias("e"), F.max("sequence").alias("sequence"))
    return last.select("listener", "track", "slot", "sequence", "e.*")


def decayed(effective_: DataFrame, half_life: int = LONG_HALF_LIFE) -> DataFrame:
    """Weight of each track by listener: signed weights, halved every half_life before the listener's newest event."""
    age = F.max("said").over(Window.partitionBy("listener")) - F.col("said")
    return effective_.withColumn("w", F.col("weight") * F.pow(F.lit(2.0), -age / half_life)).groupBy("listener", "track").agg(F.sum("w").alias("w"))


def exposures(events: DataFrame, half_life: int = SHORT_HALF_LIFE, keep: int = MOST_EXPOSURES) -> DataFrame:
    """Recent exposure of (listener, track), from 0 to 1, the strongest ones of each listener."""
    seen = events.filter("kind = 'exposure'")
    age = F.max("said").over(Window.partitionBy("listener")) - F.col("said")
    x = seen.withColumn("x", F.pow(F.lit(2.0), -age / half_life)).groupBy("listener", "track").agg((1 - F.exp(-F.sum("x"))).alias("exposure")).filter(F.col("exposure") >= LEAST_EXPOSURE)
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("listener").orderBy(F.desc(F.round("exposure", 9)), "track"))).filter(F.col("_n") <= keep).drop("_n")


def pruned(events: DataFrame, half_lives: int = 5) -> DataFrame:
    """Without exposures older than five half-lives before the newest event."""
    newest = events.agg(F.max("said").alias("newest"))  # one row
    return events.join(F.broadcast(newest)).filter((F.col("kind") != "exposure") | (F.col("said") >= F.col("newest") - half_lives * SHORT_HALF_LIFE)).drop("newest")


def centroids(weights: DataFrame, vectors: DataFrame, least: int = 2) -> DataFrame:
    """(listener, positive, i, x, support): unit centroids of liked and of disliked tracks by coordinate, where enough tracks bear on them."""
    p = weights.join(vectors.select(F.col("id").alias("track"), "vector"), "track").filter("w != 0").withColumn("positive", F.col("w") > 0)
    e = p.select("listener", "positive", "track", F.abs("w").alias("w"), F.posexplode("vector").alias("i", "v"))
    c = e.groupBy("listener", "positive", "i").agg(F.sum(F.col("w") * F.col("v")).alias("x"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    return c.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("listener", "positive"))))


def _central(p: DataFrame, *by: str) -> DataFrame:
    """Of each group of (track, w, x): its track of least weighted distance to all and that track's vector, its size and weight. Distances to all add up to the group's weight less the product with the group's weighted sum, so no pairs are made."""
    sums = p.select(*by, "w", F.posexplode("x").alias("i", "v")).groupBy(*by, "i").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    sums = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("s"))  # one number a dimension
    whole = p.groupBy(*by).agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("size")).join(sums, list(by))
    scored = p.join(whole, list(by)).withColumn("far", F.round(F.col("weight") - V.dot(F.col("x"), F.col("s")), 9))
    return scored.groupBy(*by).agg(F.min_by(F.struct("track", "x"), F.struct("far", "track")).alias("m"), F.first("size").alias("size"), F.first("weight").alias("weight"))


def clusters(weights: DataFrame, vectors: DataFrame, most: int = 4, apart: float = 0.3) -> DataFrame:
    """(listener, medoid, size, share): clusters of all of each listener's liked tracks.

    The first medoid has the least weighted distance to all, each next one is the farthest from those before while that is `apart` or more; tracks join
    the nearest, and medoids are found once more. Every step is an aggregate of (track, distance to the nearest medoid), so a listener may have any number of tracks.
    """
    kept = keeper(weights.sparkSession, "clusters")
    liked = weights.filter("w > 0").join(vectors.select(F.col("id").alias("track"), V.unit(F.col("vector")).alias("x")), "track")
    p = kept(liked.select("listener", "track", "w", "x"), "tracks")
    first = _central(p, "listener").select("listener", F.col("weight").alias("total"), "m")
    distance = 1 - V.dot(F.col("x"), F.col("m.x"))
    here = F.col("m.track") == F.col("track")
    p = kept(p.join(first, "listener").select("listener", "track", "w", "x", "total", F.lit(0).alias("cluster"), distance.alias("near"), here.alias("chosen")), "near0")
    for k in range(1, most):
        far = F.round("near", 9)
        found = p.filter("not chosen").groupBy("listener").agg(F.max_by(F.struct("track", "x", far.alias("far")), F.struct(far, -F.col("track"))).alias("m")).filter(F.col("m.far") >= apart)
        nearer = F.coalesce(distance < F.col("near"), F.lit(False))
        step = p.join(found, "listener", "left").select(
            "listener", "track", "w", "x", "total", F.when(nearer, k).otherwise(F.col("cluster")).alias("cluster"), F.when(nearer, distance).otherwise(F.col("near")).alias("near"), (F.col("chosen") | F.coalesce(here, F.lit(False))).alias("chosen"),
        )
        p = kept(step, f"near{k}")
    totals = p.groupBy("listener").agg(F.first("total").alias("total"))
    return _central(p, "listener", "cluster").join(totals, "listener").select("listener", F.col("m.track").alias("medoid"), "size", (F.col("weight") / F.col("total")).alias("share"))


def _affinities(batches: Iterator[pa.RecordBatch], names: pa.Array, set_of: np.ndarray, starts: np.ndarray, by_length: dict[int, tuple[np.ndarray, np.ndarray]], most: int | None, digits: int | None) -> Iterator[pa.RecordBatch]:
    """Rows are scored by each set of vectors once, and then said for each listener that has the set (names, with set_of in ascending order). starts: where each set begins, and the end."""
    step = max(1, min(search.BLOCK_ROWS, BLOCK_NUMBERS // int(np.diff(starts).max())))
    for whole in batches:
        for a in range(0, len(whole), step):
            batch = whole.slice(a, step)
            ids, column, m = batch.column(0), batch.column(1), min(step, len(whole) - a)
            lengths = np.asarray(column.value_lengths().fill_null(-1))
            rows = {}
            for d in by_length:
                own = np.flatnonzero(lengths == d)
                x = np.asarray(column.take(pa.array(own)).flatten(), np.float64).reshape(len(own), d)
                with np.errstate(invalid="ignore", divide="ignore"):
                    rows[d] = own, (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            first = 0
            while first < len(starts) - 1:  # as many sets as a block holds, and one at least
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK_NUMBERS // m, "right")) - 1)
                s = np.full((starts[last] - starts[first], m), np.nan)
                for d, (at, q) in by_length.items():
                    i, j = np.searchsorted(at, (starts[first], starts[last]))
                    own, x = rows[d]
                    with np.errstate(invalid="ignore"):
                        s[np.ix_(at[i:j] - starts[first], own)] = q[i:j] @ x
                best = np.fmax.reduceat(s, starts[first:last] - starts[first], axis=0)  # fmax: what is unavailable doesn't count
                if digits is not None:
                    best = np.round(best, digits) + 0.0
                yield from _said(best, ids, names, *np.searchsorted(set_of, (first, last)), set_of, first, most)
                first = last


def _said(best: np.ndarray, ids: pa.Array, names: pa.Array, one: int, end: int, set_of: np.ndarray, first: int, most: int | None) -> Iterator[pa.RecordBatch]:
    m = best.shape[1]
    few, missing = max(1, search.BLOCK_ROWS // m), bool(np.isnan(best).any())
    for a in range(one, end, few):
        here = np.arange(a, min(end, a + few))
        score = best[set_of[here] - first]
        who, what = np.repeat(here, m), ids if len(here) == 1 else ids.take(pa.array(np.tile(np.arange(m), len(here))))
        score = score.ravel()
        if most and most < m:  # all that are as good as the last of the best, so that the place in this batch decides nothing
            order = np.round(np.nan_to_num(score.reshape(-1, m), nan=-2.0), 9)
            keep = np.flatnonzero(order >= np.partition(order, -most, axis=1)[:, [-most]])
            who, what, score = who[keep], what.take(pa.array(keep)), score[keep]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), what, pa.array(score, mask=np.isnan(score) if missing else None)], names=["listener", "id", "affinity"])


def _sets(who: pa.Array, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of listeners, in order, and their vectors: the names by set, the set of each, where each set of vectors begins and ends, and unit vectors by length with their places. Listeners of the same vectors share a set."""
    here, there = np.asarray(who.fill_null(0)), np.asarray(who.is_valid())
    begins = np.flatnonzero(np.concatenate([[True], (here[1:] != here[:-1]) | (there[1:] != there[:-1])]))
    lengths, flat = np.asarray(column.value_lengths().fill_null(0)), np.asarray(column.flatten(), np.float64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    known: dict[frozenset, int] = {}
    sets: list[list[np.ndarray]] = []
    of = []
    for a, b in zip(begins, [*begins[1:], len(lengths)], strict=True):
        mine = {(v := flat[at[i] : at[i + 1]]).tobytes(): v for i in range(a, b)}
        k = known.setdefault(frozenset(mine), len(sets))
        if k == len(sets):
            sets.append(list(mine.values()))
        of.append(k)
    every = [v for vs in sets for v in vs]
    sizes, by_length = np.array([len(v) for v in every]), {}
    for k in sorted(set(sizes.tolist()) - {0}):
        own = np.flatnonzero(sizes == k)
        q = np.stack([every[i] for i in own])
        with np.errstate(invalid="ignore", divide="ignore"):
            by_length[k] = own, q / np.linalg.norm(q, axis=1, keepdims=True)
    order = np.argsort(of, kind="stable")
    return who.take(pa.array(begins[order])), np.array(of)[order], np.concatenate([[0], np.cumsum([len(vs) for vs in sets])]), by_length


def affinity(liked: DataFrame, rows: DataFrame, most: int | None = None, digits: int | None = None) -> DataFrame:
    """(listener, id, affinity): the greatest cosine of each row (id, vector) to a listener's vectors of `liked` (listener, vector), for every listener and id, or for each listener's `most` best ids (equal ones by id); rounded to `digits`, if given.

    Null where no pair can be compared (zero vectors, other lengths). Listeners' vectors are sent in blocks; each block is one scan of the rows, and listeners of the same vectors share their scores. Pairs are shuffled only where ids repeat, of whose rows the best counts.
    """
    spark = rows.sparkSession
    there, most_of_an_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    repeated = most_of_an_id > 1
    n, d = liked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks, out = max(1, -(-n * max(d or 1, 1) // search.QUERY_NUMBERS)), None
    for b in range(blocks):
        got = liked.filter(F.pmod(F.xxhash64("listener"), F.lit(blocks)) == b).select(F.col("listener").cast("long").alias("listener"), F.col("vector").cast("array<double>").alias("vector")).orderBy("listener").toArrow()
        if not len(got):
            continue
        sets = _sets(got["listener"].combine_chunks(), got["vector"].combine_chunks())
        sent = spark.sparkContext.broadcast(sets)
        # A small file of rows is one task's; what it gives for all listeners is not small.
        tasks = min(there, -(-there * len(sets[0]) // TASK_PAIRS))
        found = (rows.select("id", "vector").repartition(tasks) if tasks > 1 else rows.select("id", "vector")).mapInArrow(lambda x, sent=sent: _affinities(x, *sent.value, None if repeated else most, None if most else digits), "listener long, id long, affinity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "listener long, id long, affinity double")
    if repeated:
        out = out.groupBy("listener", "id").agg(F.max("affinity").alias("affinity"))
    if most is None:
        return out
    w = Window.partitionBy("listener").orderBy(F.desc_nulls_last(F.round("affinity", 9)), "id")
    best = out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return best if digits is None else best.withColumn("affinity", F.round("affinity", digits))
