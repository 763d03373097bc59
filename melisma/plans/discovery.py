"""Queries of anchored journeys, retrieval with budgets and discovery in batches. Requests are all vectors whose id is divisible by 50."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import discovery as D
from ..operators import journeys as J
from ..operators.search import nearest
from ..sources.tables import FEEDBACK_SQL, feedback, table, vectors
from .assembly import pool
from .registry import query
from .vectors import hits, seeds

TRACKS, EACH, WANTED, BATCH = 15, 20, 10, 8


def anchored(spark: SparkSession, d: str) -> DataFrame:
    """The pool of each request; its best candidate, the one in the middle and the least are the waypoints."""
    p = pool(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("total"), "id")))
    there = F.count(F.lit(1)).over(Window.partitionBy("request"))
    return p.withColumn("anchor", F.when(F.col("place") == 1, 0).when(F.col("place") == there, 2).when(F.col("place") == F.floor(there / 2), 1)).drop("place")


@query("anchored_journeys")
def anchored_journeys(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen tracks from the best candidate over the middle one to the least, with artists as far apart as can be."""
    return J.journeys(anchored(spark, d), TRACKS)


@query("strict_journeys")
def strict_journeys(spark: SparkSession, d: str) -> DataFrame:
    """The same where an artist must never follow itself, over candidates of few artists: fewer tracks rather than that."""
    few = anchored(spark, d).withColumn("artist", F.when(F.col("anchor").isNull(), (F.col("id") % 2).cast("string")).otherwise(F.col("artist")))
    return J.journeys(few, TRACKS, hard=1).groupBy("request").agg(F.count(F.lit(1)).alias("tracks"), F.first("gap").alias("gap"), F.first("notices").alias("notices"))


@query("waypoint_walk")
def waypoint_walk(spark: SparkSession, d: str) -> DataFrame:
    """From the best candidate to the least, with a little noise that the request decides."""

    def choose(rows: pd.DataFrame) -> list[int]:
        u, _ = A.unit(rows["vector"])
        total = rows["total"].to_numpy()
        return J.walked(rows, u[[int(np.argmax(total)), int(np.argmin(total))]], TRACKS, 0.1, int(rows["request"].iloc[0]))

    return A.per_request(pool(spark, d), choose)


def channels(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, int]]:
    """Likeness in two spaces, tracks with listeners in common, tracks heard next, and the artist's most played ones."""
    v, f = vectors(spark, d), feedback(spark, d).filter("track is not null")
    s = seeds(v).select(F.col("id").alias("request"), "artist")
    top = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= EACH).select("request", "id", "score")
    near = lambda df: df.select(F.col("query").alias("request"), "id", F.round("score", 9).alias("score"))
    half = v.withColumn("vector", F.slice("track", 1, 32))
    heard = f.select("listener", "track").distinct()
    of_seed = heard.join(s.select(F.col("request").alias("track")), "track").select("listener", F.col("track").alias("request"))
    together = of_seed.join(heard.select("listener", F.col("track").alias("id")), "listener").filter("request <> id").groupBy("request", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    after = f.select("track", F.lead("track").over(Window.partitionBy("listener").orderBy("said", "sequence")).alias("id")).join(s.select(F.col("request").alias("track")), "track").filter("id is not null and id <> track")
    after = after.groupBy(F.col("track").alias("request"), "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    plays = v.select("id", "artist").join(f.groupBy(F.col("track").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", "artist", F.coalesce("n", F.lit(0)).cast("double").alias("score"))
    # The best of each artist are few, so that an artist of many tracks brings no more rows than another.
    played = plays.withColumn("r", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= EACH + 1)
    own = s.join(played, "artist").filter("request <> id").select("request", "id", "score")
    return [("audio", near(hits(spark, d, EACH)), 6), ("track", near(nearest(half, seeds(half).select("id", "vector"), EACH)), 5), ("listeners", top(together), 4), ("next", top(after), 3), ("artist", top(own), 2)]


_CHANNELS = f"""v AS (SELECT vec_id AS id, label AS artist, embedding::DOUBLE[] AS audio, list_reverse(embedding::DOUBLE[])[1:32] AS track FROM embeddings), s AS (SELECT * FROM v WHERE id % 50 = 0), {FEEDBACK_SQL},
f AS (SELECT * FROM feedback WHERE track IS NOT NULL), heard AS (SELECT DISTINCT listener, track FROM f),
plays AS (SELECT id, artist, coalesce(n, 0)::DOUBLE AS score FROM v LEFT JOIN (SELECT track AS id, count(*) AS n FROM f GROUP BY track) USING (id)),
played AS (SELECT * FROM plays QUALIFY row_number() OVER (PARTITION BY artist ORDER BY score DESC, id) <= {EACH + 1}),
said AS (
  SELECT s.id AS request, v.id, round(list_cosine_similarity(s.audio, v.audio), 9) AS score, 0 AS place FROM s JOIN v ON s.id <> v.id
  UNION ALL SELECT s.id, v.id, round(list_cosine_similarity(s.track, v.track), 9), 1 FROM s JOIN v ON s.id <> v.id
  UNION ALL SELECT a.track, b.track, count(*)::DOUBLE, 2 FROM heard a JOIN heard b USING (listener) WHERE a.track IN (SELECT id FROM s) AND a.track <> b.track GROUP BY ALL
  UNION ALL SELECT track, id, count(*)::DOUBLE, 3 FROM (SELECT track, lead(track) OVER (PARTITION BY listener ORDER BY said, sequence) AS id FROM f) WHERE track IN (SELECT id FROM s) AND id IS NOT NULL AND id <> track GROUP BY ALL
  UNION ALL SELECT s.id, p.id, p.score, 4 FROM s JOIN played p USING (artist) WHERE s.id <> p.id),
ch AS (SELECT * FROM (VALUES (0, 'audio', 6), (1, 'track', 5), (2, 'listeners', 4), (3, 'next', 3), (4, 'artist', 2)) t(place, channel, budget)),
r AS (SELECT said.*, channel, budget, row_number() OVER (PARTITION BY request, said.place ORDER BY score DESC, id) AS rank FROM said JOIN ch USING (place) QUALIFY rank <= {EACH}),
o AS (SELECT *, row_number() OVER (PARTITION BY request, place ORDER BY rank, id) AS turn, channels FROM (SELECT *, count(*) OVER (PARTITION BY request, id) AS channels FROM r QUALIFY row_number() OVER (PARTITION BY request, id ORDER BY rank, place) = 1)),
u AS (SELECT request, count(*) FILTER (turn <= budget) AS used FROM o GROUP BY request),
x AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY turn - budget, place) AS nth FROM o WHERE turn > budget)"""


@query("budgeted_retrieval", f"""WITH {_CHANNELS} SELECT request, id, channel, turn::INTEGER AS turn, channels::INTEGER AS channels, false AS spilled FROM o WHERE turn <= budget
UNION ALL SELECT request, id, channel, turn::INTEGER, channels::INTEGER, true FROM x JOIN u USING (request) WHERE nth <= 20 - used""")
def budgeted_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Twenty candidates a request from five channels; channels says how many of them named the candidate."""
    return D.budgeted(channels(spark, d)).select("request", "id", "channel", "turn", F.size("provenance").alias("channels"), "spilled")


@query("channel_provenance", f"""WITH {_CHANNELS}, kept AS (SELECT request, id FROM o WHERE turn <= budget UNION ALL SELECT request, id FROM x JOIN u USING (request) WHERE nth <= 20 - used)
SELECT channel, count(*) AS named, 0::BIGINT AS invalid FROM kept JOIN r USING (request, id) GROUP BY channel""")
def channel_provenance(spark: SparkSession, d: str) -> DataFrame:
    """How many of the candidates each channel named, and how many of its statements it never made."""
    c = channels(spark, d)
    found = D.budgeted(c)
    named = found.select(F.explode("provenance.channel").alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("named"))
    wrong = D.invalid_provenance(found, c).groupBy("channel").agg(F.count(F.lit(1)).alias("invalid"))
    return named.join(wrong, "channel", "left").select("channel", "named", F.coalesce("invalid", F.lit(0)).alias("invalid"))


def discovered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near candidates first, then those with common listeners; accepted are tracks of the catalogue that are neither promoted nor of the request's artist."""
    v = vectors(spark, d).select("id", "artist")
    by = {name: df.select("request", "id", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id")).alias("rank")) for name, df, _ in channels(spark, d)}
    good = table(spark, d, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id")).join(v, "id")
    of = v.select(F.col("id").alias("request"), F.col("artist").alias("own"))
    return D.discover([by["audio"], by["listeners"]], lambda c: c.join(good, "id").join(of, "request").filter("artist <> own"), WANTED, BATCH)


_STREAM = f"""{_CHANNELS}, st AS (SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY place, rank, id) AS turn FROM (SELECT * FROM r WHERE place IN (0, 2) QUALIFY row_number() OVER (PARTITION BY request, id ORDER BY place, rank) = 1)),
ac AS (SELECT st.*, row_number() OVER (PARTITION BY request ORDER BY turn) AS position FROM st JOIN part ON p_partkey = st.id AND p_type <> 'PROMO' JOIN v a ON a.id = st.id JOIN v b ON b.id = st.request WHERE a.artist <> b.artist)"""


@query("iterative_discovery", f"WITH {_STREAM} SELECT request, position::INTEGER AS position, id FROM ac WHERE position <= {WANTED}")
def iterative_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Equal to filtering one pool of everything, though most candidates are never looked at."""
    return discovered(spark, d)[0]


@query("discovery_outcomes", f"""WITH {_STREAM}, n AS (SELECT request, count(*) AS there FROM st GROUP BY request), e AS (SELECT request, count(*) AS good, max(turn) FILTER (position = {WANTED}) AS enough FROM ac GROUP BY request),
b AS (SELECT k, {BATCH} * (2 ** k - 1) AS upto FROM range(1, 20) t(k)),
t AS (SELECT n.request, there, least(there, coalesce(min(upto) FILTER (upto >= enough), there))::BIGINT AS attempts FROM n LEFT JOIN e USING (request), b GROUP BY n.request, there),
g AS (SELECT t.request, count(ac.id) AS got FROM t LEFT JOIN ac ON ac.request = t.request AND ac.turn <= t.attempts GROUP BY t.request)
SELECT t.request, attempts, least(got, {WANTED})::BIGINT AS accepted, CASE WHEN got >= {WANTED} THEN 'fulfilled' ELSE 'partial' END AS outcome FROM t JOIN g USING (request)""")
def discovery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return discovered(spark, d)[2]
