"""Corpus learning: TF-IDF over artists and genres, truncated SVD, spherical k-means, quantiles, thresholds."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keeper

#: The Gram matrix of the vocabulary is held by the driver: at most so many terms. A larger vocabulary is factored by subspace_svd.
MOST_TERMS = 4096


def term_weights(tags: DataFrame) -> DataFrame:
    """(artist, term, tf): each album's distinct terms share one unit, added up by artist. Of (artist, album, term)."""
    once = tags.select("artist", "album", "term").distinct()
    n = once.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("n"))
    return once.join(n, ["artist", "album"]).groupBy("artist", "term").agg(F.sum(1 / F.col("n")).alias("tf"))


def tf_idf(tf: DataFrame) -> DataFrame:
    """(artist, term, x): rows scaled to a sum of 1, times ln((1 + N) / (1 + df)) + 1, then to length 1."""
    n = tf.select("artist").distinct().agg(F.count(F.lit(1)).alias("n_artists"))  # one row
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n_artists")) / (1 + F.col("df"))) + 1).alias("idf"))
    by = Window.partitionBy("artist")
    x = tf.join(df, "term").withColumn("x", F.col("tf") / F.sum("tf").over(by) * F.col("idf"))
    return x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(by))).select("artist", "term", "x")


def gram_svd(x: DataFrame, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms, singular values and right singular vectors of the sparse rows (artist, term, x): the terms' Gram matrix is summed on the executors, and its eigenvectors found on the driver."""
    terms = [r[0] for r in x.select("term").distinct().orderBy("term").limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    y = x.select("artist", F.col("term").alias("t2"), F.col("x").alias("x2"))
    g = x.join(y, "artist").filter("term <= t2").groupBy("term", "t2").agg(F.sum(F.col("x") * F.col("x2")).alias("g")).collect()
    at = {t: i for i, t in enumerate(terms)}
    m = np.zeros((len(terms), len(terms)))
    for r in g:
        m[at[r.term], at[r.t2]] = m[at[r.t2], at[r.term]] = r.g
    w, v = np.linalg.eigh(m)
    order = np.argsort(-w)[:k]
    v = v[:, order]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)  # signs are free: the largest entry is positive
    return terms, np.sqrt(np.maximum(w[order], 0)), v


def _times(x: DataFrame, table: DataFrame, on: str, to: str) -> DataFrame:
    """The sparse rows (artist, term, x) times a table of rows (`on`, row): rows (`to`, row). Sums by coordinate are combined before the shuffle."""
    e = x.join(table, on).select(to, F.posexplode("row").alias("i", "y"), "x").groupBy(to, "i").agg(F.sum(F.col("x") * F.col("y")).alias("y"))
    return e.groupBy(to).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("row"))


def _gram(table: DataFrame, width: int) -> np.ndarray:
    """The products of a table's columns: each task adds up its rows, and width x width numbers a task come together."""

    def run(batches):
        import pyarrow as pa

        g = np.zeros((width, width))
        for batch in batches:
            y = np.asarray(batch.column(0).flatten(), float).reshape(-1, width)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(g.ravel())], names=["i", "g"])

    out = np.zeros(width * width)
    for r in table.select("row").mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[r.i] = r.g
    return out.reshape(width, width)


def _turned(table: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """Each row times a small matrix."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y = np.asarray(batch.column(1).flatten(), float).reshape(-1, len(m)) @ m
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=[key, "row"])

    return table.select(key, "row").mapInArrow(run, f"{key} string, row array<double>")


def subspace_svd(x: DataFrame, k: int, rounds: int = 8, extra: int = 8) -> tuple[DataFrame, np.ndarray]:
    """(term, row): right singular vectors as a table, and the k greatest singular values, for a vocabulary of any size. Keyed random vectors are multiplied with the rows and back again; after each round their columns are made orthonormal by the small matrix of their products, which is all that the driver sees."""
    kept, width = keeper(x.sparkSession, "svd"), k + extra
    x = kept(x.select(F.col("artist").cast("string").alias("artist"), F.col("term").cast("string").alias("term"), "x"), "x")
    unit = lambda i: F.pmod(F.xxhash64("term", i), F.lit(1 << 20)) / float(1 << 20) - 0.5
    q = x.select("term").distinct().select("term", F.transform(F.sequence(F.lit(1), F.lit(width)), unit).alias("row"))
    for r in range(rounds + 1):
        w, u = np.linalg.eigh(_gram(q, width))
        good = w > 1e-12 * max(w.max(initial=0.0), 1e-300)
        q = _turned(q, "term", u * np.where(good, 1 / np.sqrt(np.where(good, w, 1)), 0))
        if r < rounds:
            q = kept(_times(x, kept(_times(x, q, "term", "artist"), f"y{r}"), "artist", "term"), f"q{r}")
    q = kept(q, "basis")
    w, u = np.linalg.eigh(_gram(_times(x, q, "term", "artist"), width))
    order = np.argsort(-w)[:k]
    v = kept(_turned(q, "term", u[:, order]), "v")
    at = v.select("term", F.posexplode("row").alias("i", "y")).groupBy("i").agg(F.max_by("y", F.struct(F.abs("y"), "term")).alias("y")).collect()  # k rows
    signs = np.ones(len(order))
    for r in at:
        signs[r.i] = -1.0 if r.y < 0 else 1.0  # signs are free: the largest entry is positive
    return kept(_turned(v, "term", np.diag(signs)), "signed"), np.sqrt(np.maximum(w[order], 0))


def truncated_svd(x: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(term, row) and singular values, exactly for a vocabulary that one machine can hold the products of, by subspaces beyond."""
    if x.select("term").distinct().limit(MOST_TERMS + 1).count() > MOST_TERMS:
        return subspace_svd(x, k)
    terms, s, v = gram_svd(x, k)
    return x.sparkSession.createDataFrame([(t, [float(a) for a in row]) for t, row in zip(terms, v, strict=True)], "term string, row array<double>"), s


def project(x: DataFrame, table: DataFrame) -> DataFrame:
    """(artist, vector): sparse rows in the space of a table (term, row)."""
    e = x.join(table, "term").select("artist", F.posexplode(F.transform("row", lambda a: a * F.col("x"))).alias("i", "y"))
    return e.groupBy("artist", "i").agg(F.sum("y").alias("y")).groupBy("artist").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("vector"))


def recommended_clusters(n: int) -> int:
    return int(min(256, max(2, np.floor(np.sqrt(n / 2)))))


def _assigned(batches, c: np.ndarray):
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = np.array(batch.column(1).flatten(), float).reshape(n, -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = np.round(x @ c.T, 12)
        best = s.argmax(1)
        top = s[np.arange(n), best]
        s[np.arange(n), best] = -np.inf
        second = s.argmax(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(top), pa.array(second), pa.array(s[np.arange(n), second])], names=["id", "cluster", "score", "second", "second_score"])


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, score, second, second_score): the nearest centroid and the next. Centroids are at most 256."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    return vectors.select("id", "vector").mapInArrow(lambda b: _assigned(b, sent.value), "id long, cluster long, score double, second long, second_score double")


def _sums(batches, c: np.ndarray):
    import pyarrow as pa

    k, d = c.shape
    total, n, drop = np.zeros((k, d)), np.zeros(k, np.int64), 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = x @ c.T
        best = s.argmax(1)
        np.add.at(total, best, x)
        n += np.bincount(best, minlength=k)
        drop += float((1 - s.max(1)).sum())
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.float64())), pa.array(n[some]), pa.array(np.full(len(some), drop / max(len(some), 1)))], names=["cluster", "total", "n", "loss"])


def farthest(vectors: DataFrame, c: np.ndarray, n: int) -> list[np.ndarray]:
    """The n rows, as unit vectors, that fit their nearest centroid least; the first by id of equals. None if every row is on its centroid."""
    if not n:
        return []
    a = assign(vectors, c).select("id", F.round("score", 9).alias("score")).filter("score < 1").orderBy("score", "id").limit(n)
    rows = sorted(a.join(vectors.select("id", "vector"), "id").collect(), key=lambda r: (r.score, r.id))
    return [np.array(r.vector, float) / max(np.linalg.norm(r.vector), 1e-12) for r in rows]


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 20, seed: int = 1, state: str | None = None) -> np.ndarray:
    """k unit centroids by Lloyd's rounds: each task adds up its rows by cluster, and k rows a task come together. The start is a k-means++ choice within a keyed sample, by numbers of the seed; a cluster that comes out empty begins again at the row that its own centroid fits least. With `state` each round's centroids are written there, and a run that finds some goes on from them."""
    spark = vectors.sparkSession
    sample = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("id").cast("string")), 256)).orderBy("h").limit(max(8 * k, 64)).collect()
    x = np.array([r.vector for r in sample], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    chosen, rng = [0], np.random.Generator(np.random.PCG64(seed))
    while len(chosen) < min(k, len(x)):
        far = np.round(np.maximum((1 - x @ x[chosen].T).min(1), 0), 9)
        far[chosen] = 0
        if far.sum() <= 0:  # only copies are left
            chosen.append(next(i for i in range(len(x)) if i not in chosen))
        else:
            chosen.append(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), "right").clip(0, len(x) - 1)))
    c, first = x[chosen], 0
    if state:
        try:
            rows = spark.read.parquet(state).orderBy(F.desc("round"), "cluster").limit(len(c)).collect()
            if len(rows) == len(c):
                c, first = np.array([r.centroid for r in rows]), rows[0].round + 1
        except Exception as e:  # no state yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    for r in range(first, rounds):
        sent = spark.sparkContext.broadcast(c)
        # Sums come in the order of tasks; they are rounded, so that order doesn't show.
        got = vectors.select("id", "vector").mapInArrow(lambda b, sent=sent: _sums(b, sent.value), "cluster long, total array<double>, n long, loss double").select("cluster", F.posexplode("total").alias("i", "t")).groupBy("cluster", "i").agg(F.sum("t").alias("t")).collect()
        nxt = c.copy()
        total = np.zeros_like(c)
        for g in got:
            total[g.cluster, g.i] = g.t
        norm = np.linalg.norm(total, axis=1)
        nxt[norm > 1e-12] = np.round(total[norm > 1e-12] / norm[norm > 1e-12, None], 12)
        empty = np.flatnonzero(norm <= 1e-12)
        for i, row in zip(empty.tolist(), farthest(vectors, c, len(empty)), strict=False):
            nxt[i] = row
        moved, c = float(np.abs(nxt - c).max()), nxt
        if state:
            spark.createDataFrame([(r, i, [float(a) for a in row]) for i, row in enumerate(c)], "round int, cluster int, centroid array<double>").coalesce(1).write.mode("append").parquet(state)
        if moved < 1e-6:
            break
    return c


def run_id(*parts: object) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, "\0".join(map(str, parts))).hex


def calibrated_threshold(scored: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """(threshold, precision, recall): the lowest score at or above which precision is enough, recall being greatest there. Scores are counted by value first, so the running sums go over distinct scores."""
    c = scored.groupBy("score").agg(F.sum(F.col("label").cast("int")).alias("good"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("score"))
    run = c.withColumn("tp", F.sum("good").over(w)).withColumn("taken", F.sum("n").over(w)).withColumn("all", F.sum("good").over(Window.partitionBy(F.lit(1))))
    fine = run.withColumn("precision", F.col("tp") / F.col("taken")).withColumn("recall", F.col("tp") / F.col("all")).filter(F.col("precision") >= least_precision)
    return fine.orderBy(F.desc("recall"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "precision", "recall")
