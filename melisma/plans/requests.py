"""Queries of request rules and seeds. An order is a request and its lines are the clauses; for seeds a request is a vector whose id is divisible by 50, and its pool the 64 nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import requests as R
from ..sources.tables import FEEDBACK_SQL, TRACKS_SQL, feedback, table, tracks
from . import assembly
from .registry import query

_KINDS = ("genre", "style", "composer", "mood", "require_artist", "require_style", "exclude_artist", "require_period")
_REQUESTS = """requests AS (SELECT o_orderkey AS request, CASE WHEN o_orderpriority LIKE '1%' THEN 'enhanced' ELSE 'hybrid' END AS mode, CASE WHEN o_orderstatus = 'F' THEN 'best_available' ELSE 'strict' END AS policy,
  CASE WHEN o_totalprice > 250000 THEN 3600 ELSE 0 END AS seconds, o_orderpriority LIKE '2%' AS temporal, CASE WHEN o_orderpriority LIKE '3%' THEN 'jazz' END AS single_genre FROM orders)"""
_CLAUSES = f"""clauses AS (SELECT l_orderkey AS request, CASE WHEN l_quantity < 10 THEN 'hard' WHEN l_quantity < 30 THEN 'essential' ELSE 'preference' END AS role,
  [{", ".join(f"'{k}'" for k in _KINDS)}][l_suppkey % {len(_KINDS)} + 1] AS kind, CASE WHEN l_linestatus = 'O' THEN 'v' || l_partkey ELSE ' ' END AS value,
  CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS influence, l_discount > 0.09 AS strict FROM lineitem)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    at = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request"), F.when(at == "1", "enhanced").otherwise("hybrid").alias("mode"), F.when(F.col("o_orderstatus") == "F", "best_available").otherwise("strict").alias("policy"),
        F.when(F.col("o_totalprice") > 250000, 3600).otherwise(0).alias("seconds"), (at == "2").alias("temporal"), F.when(at == "3", "jazz").alias("single_genre"),
    )


def clauses(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.when(q < 10, "hard").when(q < 30, "essential").otherwise("preference").alias("role"), F.get(F.array(*map(F.lit, _KINDS)), F.col("l_suppkey") % len(_KINDS)).alias("kind"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("v"), "l_partkey")).otherwise(" ").alias("value"), F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("influence"), (F.col("l_discount") > 0.09).alias("strict"),
    )


@query("artist_diversity", f"""WITH {_REQUESTS}, {_CLAUSES}, a AS (SELECT request, bool_or(role = 'hard' AND kind IN ('require_artist', 'require_album')) AS bound,
  bool_or(trim(value) <> '' AND ((role = 'preference' AND kind = 'genre' AND influence <> 'negative') OR (role = 'essential' AND kind IN ('genre', 'style')) OR (role = 'hard' AND kind = 'require_style'))) AS styled FROM clauses GROUP BY request)
SELECT request, mode <> 'enhanced' AND NOT coalesce(bound, false) AND (policy = 'best_available' OR coalesce(styled, false)) AS diverse FROM requests LEFT JOIN a USING (request)""")
def artist_diversity(spark: SparkSession, d: str) -> DataFrame:
    return R.artist_diversity(requests(spark, d), clauses(spark, d))


@query("walk_guard", f"""WITH {_REQUESTS}, {_CLAUSES}, a AS (SELECT request, bool_or(role = 'essential' AND kind = 'composer') AS composer, bool_or(strict) AS strict,
  bool_or(role = 'hard' AND kind NOT IN ('exclude_artist', 'exclude_reference_artists', 'no_back_to_back_artist')) AS unkept, bool_or(role = 'essential') AS verified FROM clauses GROUP BY request),
r AS (SELECT request, CASE WHEN seconds > 0 THEN 'duration' WHEN composer THEN 'composer' WHEN single_genre IS NOT NULL THEN 'single_genre' WHEN strict OR temporal OR unkept
  THEN concat_ws(',', CASE WHEN strict THEN 'audio_check' END, CASE WHEN temporal THEN 'structure' END, CASE WHEN unkept THEN 'constraint' END) WHEN verified AND policy <> 'best_available' THEN 'verification' ELSE '' END AS reasons FROM requests LEFT JOIN a USING (request))
SELECT request, reasons = '' AS supported, reasons FROM r""")
def walk_guard(spark: SparkSession, d: str) -> DataFrame:
    return R.walk_guard(requests(spark, d), clauses(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query("mapping_proposals", f"""WITH {TRACKS_SQL}, q AS (SELECT id, trim(CASE WHEN id % 11 = 0 THEN ' ' ELSE artist END) AS artist, trim(title) AS title, album FROM tracks), r AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'other' ELSE trim(artist) END AS a, md5(id::VARCHAR) AS h FROM tracks),
m AS (SELECT q.id, artist, title, album, a, CASE WHEN q.id % 5 = 0 THEN '' ELSE h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS mbid, q.id % 3 <> 0 AS named FROM q JOIN r USING (id)),
s AS (SELECT id, CASE WHEN artist = '' OR title = '' OR length(artist || title || album) > 250 THEN 'invalid_query' WHEN a <> artist OR id % 13 = 0 THEN 'mismatched' WHEN mbid = '' THEN 'none' WHEN named THEN 'proposed' ELSE 'invalid_proposal' END AS state, mbid FROM m)
SELECT id, state, CASE WHEN state = 'proposed' THEN mbid END AS mbid FROM s""")
def mapping_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Answers are made here of hashes: there is no provider. Some are for other names, doubled, empty or without a recording's name."""
    t, i = tracks(spark, d), F.col("id")
    h = F.md5(F.col("id").cast("string").cast("binary"))
    code = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    answers = t.select(
        "id", F.when(i % 7 == 0, "other").otherwise(F.trim("artist")).alias("artist_arg"), F.trim("title").alias("title_arg"), F.when(i % 5 == 0, "").otherwise(code).alias("mbid"), F.array(code).alias("artist_mbids"), F.col("artist").alias("artist_name"),
        F.when(i % 3 != 0, F.col("title")).otherwise("").alias("recording"), F.explode(F.sequence(F.lit(1), F.when(i % 13 == 0, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
    return R.mapping_proposals(t.select("id", F.when(i % 11 == 0, " ").otherwise(F.col("artist")).alias("artist"), "title", F.col("album").alias("release")), answers)


_FIT = f"""{FEEDBACK_SQL}, v AS (SELECT vec_id AS id, label::VARCHAR AS artist, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT s.id AS request, v.id, v.artist, v.v, list_cosine_similarity(s.v, v.v) AS c FROM v s, v WHERE s.id % 50 = 0 AND s.id <> v.id),
p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(c, 9) DESC, id) AS r FROM x QUALIFY r <= 64), n AS (SELECT *, (60 + min(r) OVER (PARTITION BY request)) / (60.0::DOUBLE + r) AS fusion FROM p),
h AS (SELECT track AS id, count(*) AS n, count(*) FILTER (kind = 'dislike') AS bad, count(*) FILTER (kind = 'like') AS good FROM feedback WHERE kind <> 'exposure' GROUP BY track), g AS (SELECT *, n::DOUBLE / max(n) OVER () AS familiarity FROM h),
fit AS (SELECT request, id, artist, v, coalesce(bad > good, false) AS conflicting, least(1.0, greatest(0.0, 0.9 * (round(c, 9) - CASE WHEN coalesce(bad > good, false) THEN 0.1 ELSE 0 END) + 0.07 * fusion + 0.03 * coalesce(familiarity, 0) - 0.25 * coalesce(bad::DOUBLE / g.n, 0))) AS fit
  FROM n AS m LEFT JOIN g USING (id))"""


def fitted(spark: SparkSession, d: str) -> DataFrame:
    """The pool with its fit: familiarity and dislikes come from the feedback log, reduced to one row a track."""
    said = feedback(spark, d).filter("kind != 'exposure'").groupBy(F.col("track").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "dislike", 1)).alias("bad"), F.count(F.when(F.col("kind") == "like", 1)).alias("good"))
    most = said.agg(F.max("n").alias("most"))  # one row
    said = said.join(F.broadcast(most)).select("id", (F.col("bad") > F.col("good")).alias("conflicting"), (F.col("n") / F.col("most")).alias("familiarity"), (F.col("bad") / F.col("n")).alias("negative"))
    by = Window.partitionBy("request")
    p = assembly.pool(spark, d).withColumn("rank", F.row_number().over(by.orderBy(F.desc("total"), "id"))).withColumn("fusion", (60 + F.min("rank").over(by)) / (60.0 + F.col("rank")))
    p = p.join(said, "id", "left").fillna(False, ["conflicting"])
    return p.withColumn("fit", R.automatic_fit(F.col("total"), F.col("conflicting"), F.col("fusion"), F.col("familiarity"), F.col("negative")))


@query("automatic_ranking", f"WITH {_FIT} SELECT request, id, round(fit, 6) AS fit, conflicting, row_number() OVER (PARTITION BY request ORDER BY conflicting, round(fit, 9) DESC, id) AS position FROM fit")
def automatic_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without evidence against them first, then by fit."""
    f = fitted(spark, d)
    at = F.row_number().over(Window.partitionBy("request").orderBy("conflicting", F.desc(F.round("fit", 9)), "id"))
    return f.select("request", "id", F.round("fit", 6).alias("fit"), "conflicting", at.cast("long").alias("position"))


_ORDER = """r AS (SELECT {by} AS request, id, artist, v, {total} AS total, row_number() OVER (PARTITION BY {by} ORDER BY {total} DESC, id) AS pos FROM fit),
c AS (SELECT a.request, a.id, list_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.request, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS k FROM r a JOIN r b ON a.request = b.request AND a.id <> b.id WHERE a.pos <= 12),
s AS (SELECT request, id, round(sum(c), 9) AS support FROM c WHERE k <= 16 AND c > 0 GROUP BY ALL),
o AS (SELECT request, id, artist, row_number() OVER (PARTITION BY request ORDER BY pos > 12, total DESC, coalesce(support, 0) DESC, pos) AS place FROM r LEFT JOIN s USING (request, id))"""


@query("grounded_seeds", f"WITH {_FIT}, {_ORDER.format(by='request', total='round(fit, 2)')}, f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY request, artist ORDER BY place) = 1) SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY place) AS seed FROM f QUALIFY seed <= 3")
def grounded_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Fits are compared by hundredths, so that neighbourhoods have something to decide."""
    return R.grounded_seeds(fitted(spark, d).withColumn("total", F.round("fit", 2))).select("request", "id", "seed")


@query("artist_representatives", f"WITH {_FIT}, {_ORDER.format(by='struct_pack(r := request, a := artist)', total='0.0')}, sizes AS (SELECT request, count(*) AS n FROM o GROUP BY request) SELECT request.r AS request, artist, id, place, 1.0::DOUBLE / least(3, n) AS weight FROM o JOIN sizes USING (request) WHERE place <= 3")
def artist_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is described, so the recordings that their artist's others are most like stand for the artist."""
    return R.representatives(fitted(spark, d).withColumn("total", F.col("fit")), described=False)


@query("automatic_playlists")
def automatic_playlists(spark: SparkSession, d: str) -> DataFrame:
    """From fit to playlist: one candidate reserved for each of three stages, the rest chosen for relevance and diversity, all put in order."""
    columns = ["request", "id", "artist", "album", "vector", F.col("fit").alias("total")]
    return A.per_request(fitted(spark, d).select(*columns), lambda rows: A.automatic(rows, [[int(i) % 3 == s for s in range(3)] for i in rows["id"]], 20))
