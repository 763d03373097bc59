"""Queries of feedback and taste, in batch and as streams over the same files."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import taste as P
from ..sources.scratch import folder
from ..sources.tables import FEEDBACK_SQL, feedback, table
from ..streaming import feedback as S
from .registry import query

_EFF = f"""{FEEDBACK_SQL}, s AS (SELECT *, CASE WHEN kind IN ('like','dislike','more_like','less_like') THEN 'direct' WHEN kind <> 'exposure' THEN 'review' END AS slot FROM feedback),
eff AS (SELECT * FROM s WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listener, track, slot ORDER BY sequence DESC) = 1),
w AS (SELECT listener, track, sum(x) AS w FROM (SELECT listener, track, weight * pow(2.0, -(max(said) OVER (PARTITION BY listener) - said) / {P.LONG_HALF_LIFE}.0) AS x FROM eff) GROUP BY ALL)"""


@query("effective_feedback", f"WITH {_EFF} SELECT listener, track, slot, kind, weight, sequence FROM eff")
def effective_feedback(spark: SparkSession, d: str) -> DataFrame:
    return P.effective(feedback(spark, d)).select("listener", "track", "slot", "kind", "weight", "sequence")


@query("decayed_weights", f"WITH {_EFF} SELECT listener, track, round(w, 6) AS w FROM w")
def decayed_weights(spark: SparkSession, d: str) -> DataFrame:
    return P.decayed(P.effective(feedback(spark, d))).select("listener", "track", F.round("w", 6).alias("w"))


@query("exposure_decay", f"""WITH {FEEDBACK_SQL}, e AS (SELECT listener, track, pow(2.0, -(max(said) OVER (PARTITION BY listener) - said) / {P.SHORT_HALF_LIFE}.0) AS x FROM feedback WHERE kind = 'exposure'), s AS (SELECT listener, track, 1 - exp(-sum(x)) AS exposure FROM e GROUP BY ALL)
SELECT listener, track, round(exposure, 6) AS exposure FROM s WHERE exposure >= 0.01""")
def exposure_decay(spark: SparkSession, d: str) -> DataFrame:
    return P.exposures(feedback(spark, d)).select("listener", "track", F.round("exposure", 6).alias("exposure"))


@query("exposure_retention", f"WITH {FEEDBACK_SQL} SELECT kind, count(*) AS n FROM feedback WHERE kind <> 'exposure' OR said >= (SELECT max(said) FROM feedback) - 5 * {P.SHORT_HALF_LIFE} GROUP BY kind")
def exposure_retention(spark: SparkSession, d: str) -> DataFrame:
    return P.pruned(feedback(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("feedback_scopes", f"""WITH {FEEDBACK_SQL}, s AS (SELECT *, CASE sequence % 3 WHEN 0 THEN 'durable' WHEN 1 THEN 'request' ELSE 'session' END AS scope, sequence % 5 AS request FROM feedback WHERE kind <> 'exposure'),
m AS (SELECT * FROM s WHERE scope = 'durable' OR (scope = 'request' AND request = 2))
SELECT listener, track, kind, scope FROM m QUALIFY row_number() OVER (PARTITION BY listener, track ORDER BY scope = 'request' DESC, sequence DESC) = 1""")
def feedback_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Durable events and those of this request, of which the latter win."""
    s = feedback(spark, d).filter("kind != 'exposure'").withColumn("scope", F.when(F.col("sequence") % 3 == 0, "durable").when(F.col("sequence") % 3 == 1, "request").otherwise("session"))
    s = s.filter((F.col("scope") == "durable") | ((F.col("scope") == "request") & (F.col("sequence") % 5 == 2)))
    best = s.groupBy("listener", "track").agg(F.max_by(F.struct("kind", "scope"), F.struct(F.col("scope") == "request", "sequence")).alias("e"))
    return best.select("listener", "track", "e.kind", "e.scope")


@query("taste_centroids", f"""WITH {_EFF}, v AS (SELECT vec_id AS track, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT listener, w > 0 AS positive, i, sum(abs(w) * v) AS x, count(*) AS support FROM w JOIN v USING (track) WHERE w <> 0 GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY listener, positive)) AS u FROM c)
SELECT listener, positive, support, round(max(u), 5) AS greatest, round(sum(u * u), 5) AS length FROM n GROUP BY ALL""")
def taste_centroids(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    c = P.centroids(P.decayed(P.effective(feedback(spark, d))), v)
    return c.groupBy("listener", "positive", "support").agg(F.round(F.max("x"), 5).alias("greatest"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("length"))


@query("taste_clusters")
def taste_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return P.clusters(P.decayed(P.effective(feedback(spark, d))), v)


@query("listener_affinity", f"""WITH {_EFF}, l AS (SELECT w.listener, w.track, w.w, e.embedding::DOUBLE[] AS v FROM w JOIN embeddings e ON vec_id = track WHERE w.w > 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY listener ORDER BY round(w, 9) DESC, track) AS k FROM l)
SELECT r.listener, vec_id AS id, round(max(list_cosine_similarity(v, embedding::DOUBLE[])), 6) AS affinity FROM r, embeddings WHERE k <= 2 GROUP BY ALL""")
def listener_affinity(spark: SparkSession, d: str) -> DataFrame:
    """The greatest similarity of a candidate to a listener's two strongest tracks. Every row is a candidate."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    w = P.decayed(P.effective(feedback(spark, d))).filter("w > 0.5").join(e.select(F.col("id").alias("track"), F.col("vector").alias("v")), "track")
    top = w.withColumn("k", F.row_number().over(Window.partitionBy("listener").orderBy(F.desc(F.round("w", 9)), "track"))).filter("k <= 2")
    return P.affinity(top.select("listener", F.col("v").alias("vector")), e, digits=6)


@query("asof_profile_events", f"""WITH {FEEDBACK_SQL}, q AS (SELECT listener, sequence AS query, said FROM feedback WHERE kind = 'accept'), c AS (SELECT quantile_disc(said, 0.8) AS cut FROM feedback)
SELECT q.listener, q.query, count(f.sequence) AS before, max(f.sequence) AS last FROM q CROSS JOIN c LEFT JOIN feedback f ON f.listener = q.listener AND f.said < q.said AND f.said <= c.cut GROUP BY ALL""")
def asof_profile_events(spark: SparkSession, d: str) -> DataFrame:
    """What a listener had said before each query, and not after the split's end. Both sides are sorted by listener and time and counted by a window, so no pairs are made."""
    f = feedback(spark, d)
    n = f.count()
    cut = _nearest_rank(f, "said", 0.8, n)
    q = f.filter("kind = 'accept'").select("listener", F.col("said"), F.col("sequence").alias("query"), F.lit(None).cast("long").alias("event"))
    e = f.filter(F.col("said") <= cut).select("listener", F.col("said"), F.lit(None).cast("long").alias("query"), F.col("sequence").alias("event"))
    w = Window.partitionBy("listener").orderBy("said").rangeBetween(Window.unboundedPreceding, -1)
    both = q.unionByName(e).select("listener", "query", F.count("event").over(w).alias("before"), F.max("event").over(w).alias("last"))
    return both.filter("query is not null").select("listener", "query", "before", "last")


def _nearest_rank(df: DataFrame, column: str, p: float, n: int) -> int:
    """The value at the place ceil(p * n): one row, found through counts by value."""
    k = max(1, -(-int(p * 1_000_000) * n // 1_000_000))
    c = df.groupBy(F.floor(F.col(column) / 3600).alias("h")).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("h")))
    hour = c.filter(F.col("upto") >= k).orderBy("h").first()
    inside = k - (hour.upto - hour.n)
    return df.filter(F.floor(F.col(column) / 3600) == hour.h).orderBy(column).limit(inside).agg(F.max(column)).first()[0]


@query("outcome_join", f"""WITH {FEEDBACK_SQL}, q AS (SELECT listener, track, sequence AS query, said FROM feedback WHERE kind = 'more_like'), o AS (SELECT * FROM feedback WHERE kind IN ('like', 'dislike'))
SELECT q.query, arg_max(o.kind, o.sequence) AS outcome FROM q JOIN o ON o.listener = q.listener AND o.track = q.track AND o.said >= q.said GROUP BY q.query""")
def outcome_join(spark: SparkSession, d: str) -> DataFrame:
    """The last outcome of the same listener and track at or after each request."""
    f = feedback(spark, d)
    q = f.filter("kind = 'more_like'").select("listener", "track", F.col("sequence").alias("query"), F.col("said").alias("q_at"))
    o = f.filter(F.col("kind").isin("like", "dislike")).select("listener", "track", "sequence", "kind", "said")
    return q.join(o, ["listener", "track"]).filter("said >= q_at").groupBy("query").agg(F.max_by("kind", "sequence").alias("outcome"))


@query("feedback_page", f"WITH {FEEDBACK_SQL} SELECT sequence, listener, track FROM feedback WHERE kind = 'exposure' ORDER BY said DESC, sequence DESC LIMIT 100")
def feedback_page(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).filter("kind = 'exposure'").orderBy(F.desc("said"), F.desc("sequence")).limit(100).select("sequence", "listener", "track")


def _drained(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream over the files that there are: every batch is merged into a table in the shared folder, of which only the parts that it touches are written, and what stands there is the result."""
    path, schema = f"{folder(spark)}/stream-{uuid.uuid4().hex}", stream.schema

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_batch", F.lit(number).cast("long")).persist(StorageLevel.DISK_ONLY)  # upsert reads them twice, and the state would be gone through each time
        S.upsert(rows, f"{path}/table", keys, "_batch", parts=16)
        rows.unpersist()

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    try:
        return S.current(spark, f"{path}/table").select(*schema.names)
    except FileNotFoundError:  # no batch had a row
        return spark.createDataFrame([], schema)


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_preferences", f"""WITH {_EFF} SELECT listener, track, max(kind) FILTER (slot = 'direct') AS direct_kind, max(weight) FILTER (slot = 'direct') AS direct_weight, max(kind) FILTER (slot = 'review') AS review_kind, max(weight) FILTER (slot = 'review') AS review_weight
FROM (SELECT DISTINCT listener, track FROM s) JOIN eff USING (listener, track) GROUP BY ALL""")
def stream_preferences(spark: SparkSession, d: str) -> DataFrame:
    """The same as effective_feedback, kept by a stateful stream."""
    kinds = F.create_map(*(F.lit(x) for k, v in _kinds().items() for x in (k, v[0])))
    weights = F.create_map(*(F.lit(x) for k, v in _kinds().items() for x in (k, v[1])))
    e = _events_stream(spark, d)
    rows = e.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("listener"), F.get_json_object("props", "$.k").cast("long").alias("track"), kinds[F.col("event_type")].alias("kind"), weights[F.col("event_type")].alias("weight"))
    return _drained(spark, S.preferences(rows), ["listener", "track"])


def _kinds() -> dict:
    from ..sources.tables import KINDS

    return KINDS


@query("stream_activity", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(round(value * 100)::BIGINT) / 100, 2)::DOUBLE AS value FROM events GROUP BY ALL")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of event time, each as of its last change."""
    rows = _events_stream(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    out = _drained(spark, rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value"), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("value") / 100, 2).alias("value"))


@query("append_once", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def append_once(spark: SparkSession, d: str) -> DataFrame:
    """A log appended twice: every event counts once."""
    e = table(spark, d, "events")
    return e.unionByName(e).dropDuplicates(["event_id"]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
