"""Queries of vector search and fusion. Seeds are all vectors whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.search import query_weights, fused, interleaved, nearest, ranked
from ..sources.tables import table, vectors
from .registry import query

_V = "v AS (SELECT vec_id AS id, label AS artist, embedding::DOUBLE[] AS audio, list_reverse(embedding::DOUBLE[]) AS track FROM embeddings)"
_SEEDS = "s AS (SELECT * FROM v WHERE id % 50 = 0)"
_TOP = f"""{_V}, {_SEEDS}, x AS (SELECT s.id AS query, v.id AS id, list_cosine_similarity(s.audio, v.audio) AS score FROM s JOIN v ON s.id <> v.id),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM x QUALIFY rank <= 20)"""


def seeds(v: DataFrame) -> DataFrame:
    return v.filter(F.col("id") % 50 == 0)


def hits(spark: SparkSession, d: str, k: int = 20, space: str = "audio") -> DataFrame:
    v = vectors(spark, d).withColumn("vector", F.col(space))
    return nearest(v, seeds(v).select("id", "vector"), k)


@query("cosine_topk", f"WITH {_TOP} SELECT query, id, round(score, 6) AS score, rank FROM top")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("blended_topk", f"""WITH {_V}, q AS (SELECT * FROM v WHERE id = 7), b AS (
  SELECT v.id, 0.6 * list_inner_product(q.audio, v.audio) / sqrt(list_inner_product(v.audio, v.audio)) + 0.4 * list_inner_product(q.track, v.track) / sqrt(list_inner_product(v.track, v.track)) AS score FROM q JOIN v ON q.id <> v.id)
SELECT id, round(score, 6) AS score FROM b ORDER BY round(b.score, 9) DESC, id LIMIT 64""")
def blended_topk(spark: SparkSession, d: str) -> DataFrame:
    """Two spaces by weights; rows are normalised, the query is not. One seed, so one row is broadcast."""
    v = vectors(spark, d)
    q = F.broadcast(v.filter("id = 7").select(F.col("id").alias("q"), F.col("audio").alias("qa"), F.col("track").alias("qt")))
    score = 0.6 * V.dot(F.col("qa"), F.col("audio")) / V.norm(F.col("audio")) + 0.4 * V.dot(F.col("qt"), F.col("track")) / V.norm(F.col("track"))
    return v.join(q, v["id"] != q["q"]).select("id", score.alias("s")).orderBy(F.desc(F.round("s", 9)), "id").limit(64).select("id", F.round("s", 6).alias("score"))


@query("expanding_match", f"WITH {_V}, q AS (SELECT * FROM v WHERE id = 7) SELECT v.id, round(list_cosine_similarity(q.audio, v.audio), 6) AS score FROM q JOIN v ON q.artist <> v.artist ORDER BY round(list_cosine_similarity(q.audio, v.audio), 9) DESC, v.id LIMIT 1")
def expanding_match(spark: SparkSession, d: str) -> DataFrame:
    """The best acceptable match: filters go first, so no list has to grow until one is found."""
    v = vectors(spark, d)
    q = F.broadcast(v.filter("id = 7").select(F.col("artist").alias("q_artist"), F.col("audio").alias("qa")))
    return v.join(q, v["artist"] != q["q_artist"]).select("id", V.cosine(F.col("qa"), F.col("audio")).alias("s")).orderBy(F.desc(F.round("s", 9)), "id").limit(1).select("id", F.round("s", 6).alias("score"))


@query("vector_checks", f"""WITH {_V} SELECT id, round(sqrt(list_inner_product(audio, audio)), 6) AS norm, len(audio) = 64 AND list_bool_or(list_transform(audio, lambda x: x <> 0)) AS valid,
  list_transform(audio, lambda x: x / sqrt(list_inner_product(audio, audio)))[1].round(6) AS first, round(0.75 * audio[1] + 0.25 * track[1], 6) AS quarter FROM v""")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    a, t = F.col("audio"), F.col("track")
    return vectors(spark, d).select("id", F.round(V.norm(a), 6).alias("norm"), V.valid(a, 64).alias("valid"), F.round(F.get(V.unit(a), F.lit(0)), 6).alias("first"), F.round(F.get(V.interpolate(a, t, F.lit(0.25)), F.lit(0)), 6).alias("quarter"))


@query("rrf_fusion", f"""WITH {_TOP}, t2 AS (SELECT s.id AS query, v.id AS id, list_cosine_similarity(s.track[1:32], v.track[1:32]) AS score FROM s JOIN v ON s.id <> v.id),
top2 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM t2 QUALIFY rank <= 20),
e AS (SELECT query // 50 % 2 AS request, id, 'audio' AS channel, query, rank, 1.0 AS w FROM top UNION ALL SELECT query // 50 % 2, id, 'track', query, rank, 0.5 FROM top2),
b AS (SELECT request, id, channel, query, max(w / (60 + rank)) AS x FROM e GROUP BY ALL), f AS (SELECT request, id, sum(x) AS fusion FROM b GROUP BY ALL),
n AS (SELECT request, id, fusion / max(fusion) OVER (PARTITION BY request) AS fusion FROM f)
SELECT request, id, round(fusion, 6) AS fusion, row_number() OVER (PARTITION BY request ORDER BY round(fusion, 9) DESC, id) AS rank FROM n QUALIFY rank <= 20""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    half = v.withColumn("vector", F.slice("track", 1, 32))
    a = hits(spark, d).select((F.floor(F.col("query") / 50) % 2).alias("request"), "id", F.lit("audio").alias("channel"), "query", "rank", F.lit(1.0).alias("weight"))
    t = nearest(half, seeds(half).select("id", "vector"), 20).select((F.floor(F.col("query") / 50) % 2).alias("request"), "id", F.lit("track").alias("channel"), "query", "rank", F.lit(0.5).alias("weight"))
    f = fused(a.unionByName(t))
    return ranked(f, ["request"], 20, F.desc(F.round("fusion", 9)), F.col("id")).select("request", "id", F.round("fusion", 6).alias("fusion"), "rank")


@query("round_robin_interleave", f"WITH {_TOP}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS turn FROM top), u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, query) AS f FROM t) SELECT id, query, rank, row_number() OVER (ORDER BY turn, query) AS position FROM u WHERE f = 1")
def round_robin_interleave(spark: SparkSession, d: str) -> DataFrame:
    return interleaved(hits(spark, d).select("id", "query", "rank"), "query", "rank", "id")


@query("channel_union", f"""WITH {_TOP} SELECT id, count(*) AS evidence, min(rank) AS best_rank, round(max(score), 6) AS best_score, list_sort(list(query)) AS queries FROM top GROUP BY id""")
def channel_union(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("evidence"), F.min("rank").alias("best_rank"), F.round(F.max("score"), 6).alias("best_score"), F.sort_array(F.collect_list("query")).alias("queries"))


@query("exploration_pool", f"""WITH {_TOP}, b AS (SELECT id, max(score) AS score FROM top WHERE rank > 5 GROUP BY id HAVING max(score) >= 0.1), p AS (SELECT * FROM b ORDER BY round(score, 9) DESC, id LIMIT 40)
SELECT id, sha256('11' || chr(0) || id) AS h FROM p ORDER BY h LIMIT 8""")
def exploration_pool(spark: SparkSession, d: str) -> DataFrame:
    """Beyond each query's budget: the best option of an id, the top of these, and of them a keyed sample."""
    b = hits(spark, d).filter("rank > 5").groupBy("id").agg(F.max("score").alias("score")).filter("score >= 0.1").orderBy(F.desc(F.round("score", 9)), "id").limit(40)
    return b.select("id", F.sha2(F.concat(F.lit("11\0"), F.col("id").cast("string")), 256).alias("h")).orderBy("h").limit(8)


@query("damped_fusion", f"""WITH {_TOP}, c AS (SELECT t.*, v.artist, count(*) OVER (PARTITION BY t.query, v.artist) AS n FROM top t JOIN v USING (id))
SELECT id, round(sum(1 / sqrt(n) / (60 + rank)), 9) AS fusion FROM c GROUP BY id""")
def damped_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion in which hits of a crowded cluster weigh less."""
    from pyspark.sql import Window

    c = hits(spark, d).join(vectors(spark, d).select("id", "artist"), "id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query", "artist")))
    return c.groupBy("id").agg(F.round(F.sum(1 / F.sqrt("n") / (60 + F.col("rank"))), 9).alias("fusion"))


@query("weighted_centroids", f"WITH {_V}, e AS (SELECT artist, generate_subscripts(audio, 1) AS i, unnest(audio) * (1 + id % 3) AS x FROM v), c AS (SELECT artist, i, sum(x) AS x FROM e GROUP BY ALL), n AS (SELECT artist, i, x / sqrt(sum(x * x) OVER (PARTITION BY artist)) AS x FROM c) SELECT artist, list(round(x, 6) ORDER BY i) AS centroid FROM n GROUP BY artist")
def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Sums by coordinate: partial sums are combined before the shuffle, and no vector list is gathered."""
    from pyspark.sql import Window

    e = vectors(spark, d).select("artist", (1 + F.col("id") % 3).alias("w"), F.posexplode("audio").alias("i", "x"))
    c = e.groupBy("artist", "i").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    c = c.withColumn("x", F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("artist"))), 6))
    return c.groupBy("artist").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


@query("neighbourhood_support", f"WITH {_TOP}, p AS (SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM top WHERE score > 0) SELECT query, round(sum(score), 6) AS support FROM p WHERE r <= 16 GROUP BY query")
def neighbourhood_support(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).filter("score > 0 and rank <= 16").groupBy("query").agg(F.round(F.sum("score"), 6).alias("support"))


@query("journey_waypoints", f"""WITH {_V}, w AS (SELECT row_number() OVER (ORDER BY id) - 1 AS seg, audio, lead(audio) OVER (ORDER BY id) AS nxt FROM v WHERE id IN (7, 57, 107)),
p AS (SELECT unnest(range(0, 11)) AS step), t AS (SELECT step, step / 10.0 * 2 AS pos FROM p), j AS (SELECT step, seg, pos - seg AS f, audio, nxt FROM t JOIN w ON seg = least(floor(pos), 1)),
g AS (SELECT step, list_transform(list_zip(audio, nxt), lambda z: (1 - f) * z[1] + f * z[2]) AS target FROM j),
x AS (SELECT step, id, list_cosine_similarity(target, v.audio) AS s FROM g, v)
SELECT step, id, round(s, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY step ORDER BY round(s, 9) DESC, id) = 1""")
def journey_waypoints(spark: SparkSession, d: str) -> DataFrame:
    """Eleven points of a path through three vectors, and the nearest row of each."""
    v = vectors(spark, d)
    way = [r.audio for r in v.filter(F.col("id").isin(7, 57, 107)).orderBy("id").collect()]
    rows = []
    for step in range(11):
        pos = step / 10 * 2
        k = min(int(pos), 1)
        f = pos - k
        rows.append((step, [(1 - f) * a + f * b for a, b in zip(way[k], way[k + 1], strict=True)]))
    q = spark.createDataFrame(rows, "id long, vector array<double>")
    return nearest(v.withColumn("vector", F.col("audio")), q, 1, exclude_self=False).select(F.col("query").alias("step"), "id", F.round("score", 6).alias("score"))


@query("query_composition", """
WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM benchmark), k AS (SELECT item_id, term, length(term) * 7 AS vec_id FROM t),
e AS (SELECT item_id, term, embedding::DOUBLE[] AS x FROM k LEFT JOIN embeddings USING (vec_id))
SELECT item_id, count(*) AS terms, count(x) AS known, round(avg(x[1]), 6) AS first FROM e GROUP BY item_id""")
def query_composition(spark: SparkSession, d: str) -> DataFrame:
    """A text's vector is the mean of its known terms' vectors, with a ledger of what was known. The vocabulary is the vector of 7 times a term's length."""
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("term")).withColumn("vec_id", (F.length("term") * 7).cast("long"))
    e = t.join(table(spark, d, "embeddings"), "vec_id", "left")
    return e.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"), F.count("embedding").alias("known"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first"))


@query("reference_query_weights", """WITH w AS (SELECT l_orderkey AS grp, l_partkey AS track, max(l_quantity)::BIGINT AS weight FROM lineitem GROUP BY ALL), n AS (SELECT *, sum(weight) OVER (PARTITION BY grp) AS total, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, track) AS k FROM w)
SELECT grp, track, round(weight / total::BIGINT, 6) AS weight, k = 1 AS is_primary FROM n""")
def reference_query_weights(spark: SparkSession, d: str) -> DataFrame:
    """The query plan of reference groups: an order is a group, its parts the representatives, quantities their weights."""
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("track")).agg(F.max("l_quantity").cast("long").alias("weight"))
    return query_weights(w, "grp", "track").select("grp", "track", F.round("weight", 6).alias("weight"), "is_primary")
