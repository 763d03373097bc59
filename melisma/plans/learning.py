"""Queries of corpus learning. Parts are albums of their brand; a term is the type or a word of the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import learning as L
from ..sources.tables import table
from .registry import query

_TF = """t AS (SELECT DISTINCT p_brand AS artist, p_size AS album, unnest(list_concat([lower(p_type)], string_split(p_name, ' '))) AS term FROM part), n AS (SELECT artist, album, count(*) AS n FROM t GROUP BY ALL), tf AS (SELECT artist, term, sum(1.0::DOUBLE / n) AS tf FROM t JOIN n USING (artist, album) GROUP BY ALL)"""
_X = f"""{_TF}, df AS (SELECT term, ln((1 + (SELECT count(DISTINCT artist) FROM tf))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), y AS (SELECT artist, term, tf / sum(tf) OVER (PARTITION BY artist) * idf AS x FROM tf JOIN df USING (term)), x AS (SELECT artist, term, x / sqrt(sum(x * x) OVER (PARTITION BY artist)) AS x FROM y)"""


def _tf(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return L.term_weights(p.select(F.col("p_brand").alias("artist"), F.col("p_size").alias("album"), F.explode(F.concat(F.array(F.lower("p_type")), F.split("p_name", " "))).alias("term")))


@query("term_frequencies", f"WITH {_TF} SELECT artist, term, round(tf, 6) AS tf FROM tf")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _tf(spark, d).select("artist", "term", F.round("tf", 6).alias("tf"))


@query("tfidf_idf", f"WITH {_X} SELECT artist, term, round(x, 6) AS x FROM x")
def tfidf_idf(spark: SparkSession, d: str) -> DataFrame:
    return L.tf_idf(_tf(spark, d)).select("artist", "term", F.round("x", 6).alias("x"))


@query("sparse_cosine", f"WITH {_X} SELECT b.artist, round(sum(a.x * b.x), 6) AS score FROM x a JOIN x b USING (term) WHERE a.artist = 'Brand#11' GROUP BY b.artist")
def sparse_cosine(spark: SparkSession, d: str) -> DataFrame:
    x = L.tf_idf(_tf(spark, d))
    a = x.filter("artist = 'Brand#11'").select("term", F.col("x").alias("a"))
    return x.join(a, "term").groupBy("artist").agg(F.round(F.sum(F.col("a") * F.col("x")), 6).alias("score"))


@query("truncated_svd")
def truncated_svd(spark: SparkSession, d: str) -> DataFrame:
    x = L.tf_idf(_tf(spark, d))
    return L.project(x, L.truncated_svd(x, 8)[0]).select("artist", F.transform("vector", lambda a: F.round(a, 6)).alias("vector"))


@query("spherical_kmeans")
def spherical_kmeans(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    c = L.spherical_kmeans(v, L.recommended_clusters(v.count()))
    return L.assign(v, c).select("id", "cluster", F.round("score", 6).alias("score"), "second", F.round("second_score", 6).alias("second_score"))


@query("nearest_centroids", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT id // 100 AS cluster, v AS c FROM v WHERE id IN (0, 100, 200, 300)), s AS (SELECT id, cluster, list_cosine_similarity(v, c) AS s FROM v, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, cluster) AS k FROM s)
SELECT id, max(cluster) FILTER (k = 1) AS cluster, round(max(s) FILTER (k = 1), 6) AS score, max(cluster) FILTER (k = 2) AS second FROM r GROUP BY id""")
def nearest_centroids(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    c = np.array([r.vector for r in v.filter(F.col("id").isin(0, 100, 200, 300)).orderBy("id").collect()])
    return L.assign(v, c / np.linalg.norm(c, axis=1, keepdims=True)).select("id", "cluster", F.round("score", 6).alias("score"), "second")


@query("cluster_count", "SELECT least(256, greatest(2, floor(sqrt(count(*) / 2.0))))::BIGINT AS clusters FROM embeddings")
def cluster_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.least(F.lit(256), F.greatest(F.lit(2), F.floor(F.sqrt(F.count(F.lit(1)) / 2.0)))).cast("long").alias("clusters"))


@query("type7_quantiles", "SELECT l_returnflag, list_transform(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]), lambda x: round(x, 4)) AS q, count(*) AS known FROM lineitem GROUP BY 1")
def type7_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles; values are counted by value before the shuffle, so what a group gathers is its distinct values."""
    q = F.percentile("l_extendedprice", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.transform(q, lambda x: F.round(x, 4)).alias("q"), F.count("l_extendedprice").alias("known"))


@query("midrank_percentile", "SELECT c_mktsegment, round(((count(*) FILTER (c_acctbal < 5000)) + (count(*) FILTER (c_acctbal <= 5000))) / (2.0 * count(*)), 6)::DOUBLE AS percentile FROM customer GROUP BY 1")
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round((F.count(F.when(b < 5000, 1)) + F.count(F.when(b <= 5000, 1))) / (2.0 * F.count(F.lit(1))), 6).alias("percentile"))


@query("measurement_states", "SELECT event_type, count(*) FILTER (value > 1) AS known, count(*) FILTER (value <= 1) AS missing, count(*) FILTER (value IS NULL) AS absent FROM events GROUP BY 1")
def measurement_states(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.when(v > 1, 1)).alias("known"), F.count(F.when(v <= 1, 1)).alias("missing"), F.count(F.when(v.isNull(), 1)).alias("absent"))


@query("library_percentile", "SELECT vec_id AS id, round(percent_rank() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 4)), 6) AS p FROM embeddings")
def library_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.percent_rank().over(Window.partitionBy("label").orderBy(F.round(F.col("embedding")[0].cast("double"), 4))), 6).alias("p"))


@query("threshold_calibration", """WITH s AS (SELECT round(n_chars / 20.0)::BIGINT AS score, quality AS label FROM documents JOIN labels USING (doc_id)), c AS (SELECT score, sum(label)::BIGINT AS good, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT score, sum(good) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY score DESC)::DOUBLE AS taken, sum(good) OVER ()::DOUBLE AS al FROM c) SELECT score AS threshold, tp / taken AS precision, tp / al AS recall FROM r WHERE tp / taken >= 0.8 ORDER BY recall DESC, score DESC LIMIT 1""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / 20.0).cast("long").alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return L.calibrated_threshold(s, 0.8)
