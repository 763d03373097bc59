"""What words ask of measurements: phrases mean ranges of a measure, and tracks meet them by how far they are within."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrase, measure, least, most (null: open), and how far outside a track still counts a little.
RANGES = [
    ("slow", "bpm", 0, 90, 20), ("mellow", "bpm", 0, 105, 20), ("moderate", "bpm", 90, 120, 15), ("fast", "bpm", 125, None, 20), ("running", "bpm", 150, 185, 15), ("workout", "bpm", 120, 160, 15),
    ("quiet", "loudness", None, -18, 6), ("calm", "loudness", None, -14, 6), ("loud", "loudness", -9, None, 4), ("dark", "brightness", None, 1500, 500), ("warm", "brightness", 800, 2200, 400), ("bright", "brightness", 2500, None, 500),
    ("danceable", "danceability", 0.6, None, 0.2), ("party", "danceability", 0.6, None, 0.2), ("energetic", "energy", 0.65, None, 0.2), ("aggressive", "energy", 0.75, None, 0.2), ("relaxing", "energy", None, 0.4, 0.2), ("sleep", "energy", None, 0.25, 0.15),
]


def rules(spark: SparkSession) -> DataFrame:
    as_float = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(p, m, as_float(lo), as_float(hi), float(edge)) for p, m, lo, hi, edge in RANGES], "phrase string, measure string, least double, most double, edge double")


def preferences(wishes: DataFrame, tracks: DataFrame, rules: DataFrame, best: int) -> DataFrame:
    """request, id, preference, measured, missing, rank: each request's `best` tracks by its phrases.

    wishes: request, phrase, wanted (false: to be avoided). tracks: id, and measures as a map by name. A phrase is worth 1 within its range, falls to 0 over its edge, and is turned round where it is to be avoided. The preference is the mean over
    the phrases that a track has measurements for; missing counts the others, and a track without any has no preference and no rank: it is unknown, not bad. Phrases without a rule ask nothing.
    Tracks are measured once for each combination of phrases, of which requests have few, not once for each request.
    """
    asked = wishes.join(rules.select("phrase").distinct(), "phrase").groupBy("request").agg(F.sort_array(F.collect_set(F.struct("phrase", "wanted"))).alias("wish"))
    sets = asked.select("wish").distinct().select("wish", F.size("wish").alias("size"), F.explode("wish").alias("w")).select("wish", "size", "w.*")
    values = tracks.select("id", F.explode("measures").alias("measure", "value")).filter("value is not null")
    outside = F.greatest(F.coalesce(F.col("least") - F.col("value"), F.lit(0.0)), F.coalesce(F.col("value") - F.col("most"), F.lit(0.0)), F.lit(0.0))
    worth = values.join(rules, "measure").select("id", "phrase", F.greatest(F.lit(0.0), 1 - outside / F.col("edge")).alias("worth"))
    met = worth.join(sets, "phrase").groupBy("wish", "size", "id").agg(F.round(F.avg(F.when(F.col("wanted"), F.col("worth")).otherwise(1 - F.col("worth"))), 9).alias("preference"), F.count(F.lit(1)).alias("measured"))
    scored = met.select("wish", "id", "preference", "measured", (F.col("size") - F.col("measured")).alias("missing"))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("wish").orderBy(F.desc("preference"), "missing", "id"))).filter(F.col("rank") <= best)
    return asked.join(top, "wish").select("request", "id", "preference", "measured", "missing", "rank")
