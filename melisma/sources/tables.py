"""Parquet tables, and the music-domain views that queries take of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: a part is a track, its brand the artist, its type the genre, its size the album number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"),
        F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("album"), (F.col("p_retailprice") * 100).cast("long").alias("duration_ms"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two embedding spaces: the stored vector, and the same values in reverse; the label is the artist."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("artist"), F.col("embedding").cast("array<double>").alias("audio"), F.reverse(F.col("embedding").cast("array<double>")).alias("track"))


#: What an event says about a track: kind and signed weight.
KINDS = {"purchase": ("like", 1.0), "click": ("more_like", 0.8), "error": ("dislike", -1.0), "view": ("exposure", 0.0), "signup": ("accept", 0.35)}


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback log: sequence, listener, track, kind, weight and seconds since 1970."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[0])))
    weight = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[1])))
    return e.select(
        F.col("event_id").alias("sequence"), F.col("user_id").alias("listener"), F.get_json_object("props", "$.k").cast("long").alias("track"), kind[F.col("event_type")].alias("kind"), weight[F.col("event_type")].alias("weight"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("said"),
    )


FEEDBACK_SQL = """feedback AS (
  SELECT event_id AS sequence, user_id AS listener, json_extract_string(props, '$.k')::BIGINT AS track,
    CASE event_type WHEN 'purchase' THEN 'like' WHEN 'click' THEN 'more_like' WHEN 'error' THEN 'dislike' WHEN 'view' THEN 'exposure' WHEN 'signup' THEN 'accept' END AS kind,
    CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.8 WHEN 'error' THEN -1.0 WHEN 'view' THEN 0.0 WHEN 'signup' THEN 0.35 END::DOUBLE AS weight,
    floor(epoch(ts))::BIGINT AS said
  FROM events)"""
TRACKS_SQL = """tracks AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS genre, p_brand || ' ' || p_size AS album, (p_retailprice * 100)::BIGINT AS duration_ms FROM part)"""
