"""Queries of evidence, eligibility and ranking. Candidates are parts; evidence is derived from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..sources.tables import TRACKS_SQL, table, tracks
from .registry import query


@query("evidence_tristate", f"""WITH {TRACKS_SQL}, f AS (SELECT id, genre, 0.4 + (id % 7) / 10.0 AS c, id % 5 <> 0 AS complete FROM tracks),
e AS (SELECT id, CASE WHEN genre = 'PROMO' AND c BETWEEN 0.6 AND 1 THEN 'match' WHEN complete AND c BETWEEN 0.6 AND 1 THEN 'mismatch' ELSE 'unknown' END AS state FROM f)
SELECT id, state, CASE WHEN id % 2 = 0 THEN state = 'mismatch' ELSE state = 'match' END AS satisfied FROM e""")
def evidence_tristate(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    conf = F.expr("0.4D + (id % 7) / 10.0D")
    values = F.array(F.struct(F.col("genre").alias("value"), F.round(conf, 6).alias("confidence"), F.lit("tags").alias("source")))
    s = t.select("id", E.facet(values, F.col("id") % 5 != 0, F.lit("PROMO")).alias("state"))
    return s.select("id", "state", E.satisfied(F.col("state"), F.col("id") % 2 == 0).alias("satisfied"))


_EV = f"""{TRACKS_SQL}, e AS (
  SELECT id, 'playlist' AS scope, 1 AS g, CASE WHEN id % 3 = 0 THEN 'match' WHEN id % 3 = 1 THEN 'unknown' ELSE 'mismatch' END AS state FROM tracks UNION ALL
  SELECT id, 'playlist', 1, CASE WHEN id % 4 = 0 THEN 'match' ELSE 'unknown' END FROM tracks UNION ALL SELECT id, 'playlist', 2, CASE WHEN id % 5 <> 0 THEN 'match' ELSE 'mismatch' END FROM tracks UNION ALL
  SELECT id, 'stage1', 1, CASE WHEN id % 2 = 0 THEN 'match' ELSE 'mismatch' END FROM tracks UNION ALL SELECT id, 'stage2', 1, CASE WHEN id % 7 = 0 THEN 'match' ELSE 'mismatch' END FROM tracks)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    row = lambda scope, g, state: F.struct(F.lit(scope).alias("scope"), F.lit(g).alias("group"), state.alias("state"))
    two = lambda m, no: F.when(m, "match").otherwise(no)
    rows = F.array(
        row("playlist", 1, F.when(i % 3 == 0, "match").when(i % 3 == 1, "unknown").otherwise("mismatch")), row("playlist", 1, two(i % 4 == 0, "unknown")), row("playlist", 2, two(i % 5 != 0, "mismatch")),
        row("stage1", 1, two(i % 2 == 0, "mismatch")), row("stage2", 1, two(i % 7 == 0, "mismatch")),
    )
    return tracks(spark, d).select("id", F.explode(rows).alias("e")).select("id", "e.*")


@query("criteria_bool_and_or", f"""WITH {_EV}, g AS (SELECT id, scope, g, bool_or(state = 'match') AS ok FROM e GROUP BY ALL), s AS (SELECT id, scope, bool_and(ok) AS ok FROM g GROUP BY ALL)
SELECT id FROM s GROUP BY id HAVING bool_and(ok) FILTER (scope = 'playlist') AND bool_or(ok) FILTER (scope <> 'playlist')""")
def criteria_bool_and_or(spark: SparkSession, d: str) -> DataFrame:
    return E.essential(_states(spark, d))


@query("best_available_filter", f"""WITH {_EV}, s AS (SELECT id, scope, bool_or(state = 'mismatch') AS bad FROM e GROUP BY ALL) SELECT id FROM s GROUP BY id HAVING NOT bool_or(bad) FILTER (scope = 'playlist') AND NOT bool_and(bad) FILTER (scope <> 'playlist')""")
def best_available_filter(spark: SparkSession, d: str) -> DataFrame:
    return E.not_contradicted(_states(spark, d))


@query("criterion_counts", f"WITH {_EV} SELECT scope, g::INTEGER AS g, state, count(*) AS n FROM e GROUP BY ALL")
def criterion_counts(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).groupBy("scope", F.col("group").alias("g"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("hard_exclusions", f"""WITH {TRACKS_SQL} SELECT id, title, artist FROM tracks WHERE id % 10 <> 0 AND artist <> 'Brand#11' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = id AND l_orderkey <= 20) QUALIFY row_number() OVER (PARTITION BY lower(artist), lower(title) ORDER BY id) = 1""")
def hard_exclusions(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).withColumn("recording", F.concat_ws("\0", F.lower("artist"), F.lower("title")))
    ids = t.filter("id % 10 = 0").select("id")
    artists = t.filter("artist = 'Brand#11'").select("artist").distinct()
    used = table(spark, d, "lineitem").filter("l_orderkey <= 20").select(F.col("l_partkey").alias("id"))
    return E.eligible(t, (ids, ["id"]), (artists, ["artist"]), (used, ["id"]), key="recording", order="id").select("id", "title", "artist")


@query("required_artists", f"WITH {TRACKS_SQL} SELECT id, artist FROM tracks WHERE artist IN (SELECT artist FROM tracks WHERE id IN (5, 6, 7)) AND 1950 + id % 70 BETWEEN 1970 AND 1999")
def required_artists(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    wanted = t.filter(F.col("id").isin(5, 6, 7)).select("artist").distinct()
    return t.filter((1950 + F.col("id") % 70).between(1970, 1999)).join(wanted, "artist", "left_semi").select("id", "artist")


@query("transparent_total", f"""WITH {TRACKS_SQL}, c AS (SELECT id, id % 4 AS request, CASE WHEN id % 3 <> 0 THEN (id % 100) / 100.0 END::DOUBLE AS retrieval, CASE WHEN id % 4 < 2 AND id % 7 <> 0 THEN (id % 50) / 50.0 END::DOUBLE AS listener, (id % 9) / 9.0 AS negative, (id % 11) / 8.0 AS exposure FROM tracks),
u AS (SELECT *, max(retrieval IS NOT NULL) OVER w AS a, max(listener IS NOT NULL) OVER w AS b FROM c WINDOW w AS (PARTITION BY request))
SELECT id, request, round(CASE WHEN a OR b THEN (CASE WHEN a THEN coalesce(retrieval, 0) * 0.15 ELSE 0 END + CASE WHEN b THEN coalesce(listener, 0) * 0.30 ELSE 0 END) / (CASE WHEN a THEN 0.15 ELSE 0 END + CASE WHEN b THEN 0.30 ELSE 0 END) ELSE 0 END
  - 0.65 * least(greatest(negative, 0), 1) - 0.30 * least(greatest(exposure, 0), 1), 6) AS total FROM u""")
def transparent_total(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    c = tracks(spark, d).select("id", (i % 4).alias("request"), F.when(i % 3 != 0, (i % 100) / 100.0).alias("retrieval"), F.when((i % 4 < 2) & (i % 7 != 0), (i % 50) / 50.0).alias("listener"), ((i % 9) / 9.0).alias("negative"), ((i % 11) / 8.0).alias("exposure"))
    return c.select("id", "request", F.round(E.total({"retrieval": 0.15, "listener": 0.30}, "request", {"negative": 0.65, "exposure": 0.30}), 6).alias("total"))


@query("priority_blends", f"""WITH {TRACKS_SQL}, c AS (SELECT id, (id % 10) / 10.0 AS p, CASE WHEN id % 3 = 0 THEN (id % 7) / 7.0 END AS s FROM tracks) SELECT id, round(CASE WHEN s IS NULL THEN p ELSE (p + 0.25 * s) / 1.25 END, 6) AS blend, round(least(1.0, p + 0.25 * coalesce(s, 0) + 0.0625 * p), 6) AS negative FROM c""")
def priority_blends(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    p, s = (i % 10) / 10.0, F.when(i % 3 == 0, (i % 7) / 7.0)
    return tracks(spark, d).select("id", F.round(E.priority_blend(p, s), 6).alias("blend"), F.round(E.layered_negative(p, s, p), 6).alias("negative"))


@query("competition_rank_fusion", f"""WITH {TRACKS_SQL}, c AS (SELECT id, artist, unnest([id % 13, CASE WHEN id % 5 <> 0 THEN id % 17 END]) AS v, unnest([1, 2]) AS channel FROM tracks), r AS (SELECT id, channel, v, rank() OVER (PARTITION BY artist, channel, v IS NULL ORDER BY v DESC) AS r FROM c)
SELECT id, round(avg(CASE WHEN v IS NOT NULL THEN 61.0 / (60 + r) END), 6) AS estimate FROM r GROUP BY id""")
def competition_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    c = tracks(spark, d).select("id", "artist", F.posexplode(F.array(i % 13, F.when(i % 5 != 0, i % 17))).alias("channel", "v"))
    return E.competition(c, "v", ["artist", "channel"]).groupBy("id").agg(F.round(F.avg("estimate"), 6).alias("estimate"))


@query("percent_rank_popularity", "SELECT c_custkey, c_nationkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -2)) AS popularity FROM customer WHERE c_acctbal > 0")
def percent_rank_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Among those with a count, by nation; ties share a rank, and rows without a count have none."""
    c = table(spark, d, "customer").filter("c_acctbal > 0")
    return c.select("c_custkey", "c_nationkey", F.percent_rank().over(Window.partitionBy("c_nationkey").orderBy(F.round("c_acctbal", -2))).alias("popularity"))


@query("popularity_order", "SELECT c_custkey, c_nationkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS rank FROM customer) WHERE rank <= 10")
def popularity_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("pop"), "c_custkey")
    return table(spark, d, "customer").withColumn("pop", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("c_custkey", "c_nationkey", "rank")


@query("classifier_margins", f"""WITH {TRACKS_SQL}, p AS (SELECT id, artist, (id % 10) / 10.0 AS a, 1 - (id % 10) / 10.0 + CASE WHEN id % 8 = 0 THEN 0.5 ELSE 0 END AS b FROM tracks), m AS (SELECT id, artist, CASE WHEN b BETWEEN 0 AND 1 AND abs(a + b - 1) <= 0.02 THEN a - b END AS m FROM p)
SELECT artist, round(avg(m), 6) AS margin, CASE WHEN round(avg(m), 9) >= 0.5 THEN 'match' WHEN round(avg(m), 9) <= -0.5 THEN 'mismatch' ELSE 'unknown' END AS state, count(m) AS used FROM m GROUP BY artist""")
def classifier_margins(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    a = (i % 10) / 10.0
    probs = F.create_map(F.lit("happy"), a, F.lit("sad"), F.lit(1.0) - a + F.when(i % 8 == 0, 0.5).otherwise(0.0))
    m = tracks(spark, d).select("artist", E.margin(probs, "happy").alias("m"))
    return m.groupBy("artist").agg(F.round(F.avg("m"), 6).alias("margin"), E.state_of(F.round(F.avg("m"), 9)).alias("state"), F.count("m").alias("used"))


#: Discounts are whole hundredths, quantities whole numbers: sums of integers are the same in any order.
_CENTS = "cast(round(l_discount * 100) as bigint)"
_CENTS_SQL = "round(l_discount * 100)::BIGINT"


@query("segment_scores", f"""SELECT l_orderkey, (2000000 * sum({_CENTS_SQL})::BIGINT + count(*)) // (2 * count(*)) AS wanted, max({_CENTS_SQL}) * 1000000 AS unwanted,
(2000000 * sum({_CENTS_SQL} * l_quantity::BIGINT)::BIGINT + sum(l_quantity::BIGINT)::BIGINT) // (2 * sum(l_quantity::BIGINT)::BIGINT) AS by_seconds FROM lineitem GROUP BY l_orderkey""")
def segment_scores(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines are the segments, quantities the seconds; a recording's segments are few, so they fit an array. In millionths of a hundredth, rounded as whole numbers."""
    q = F.col("l_quantity").cast("long")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.expr(_CENTS).alias("score"), q.alias("seconds"))).alias("s"))
    score = lambda negative, by: E.segment_millionths(F.col("s"), F.lit(negative), by)
    return g.select("l_orderkey", score(False, False).alias("wanted"), score(True, False).alias("unwanted"), score(False, True).alias("by_seconds"))


@query("facet_balanced_score", f"WITH f AS (SELECT l_orderkey, l_returnflag, round(sum({_CENTS_SQL})::BIGINT / count(*) * 1000000)::BIGINT AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, sum(s)::BIGINT / count(*) AS score, max(s) AS best_stage FROM f GROUP BY l_orderkey")
def facet_balanced_score(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each facet, then of the facets, and the best facet; in millionths of a hundredth."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.round(F.sum(F.expr(_CENTS)) / F.count(F.lit(1)) * 1000000).cast("long").alias("s"))
    return f.groupBy("l_orderkey").agg((F.sum("s") / F.count(F.lit(1))).alias("score"), F.max("s").alias("best_stage"))


@query("reference_similarity", f"WITH r AS (SELECT l_orderkey, l_suppkey, sum({_CENTS_SQL} * l_quantity::BIGINT)::BIGINT / sum(l_quantity::BIGINT)::BIGINT AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(max(s), 6) AS similarity FROM r GROUP BY l_orderkey")
def reference_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean over a reference's representatives, the greatest over references; in hundredths."""
    q = F.col("l_quantity").cast("long")
    r = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.sum(F.expr(_CENTS) * q) / F.sum(q)).alias("s"))
    return r.groupBy("l_orderkey").agg(F.round(F.max("s"), 6).alias("similarity"))


@query("scope_fit", f"""WITH {_EV}, s AS (SELECT id, scope, g, max(CASE state WHEN 'match' THEN 1.0 WHEN 'unknown' THEN 0.0 ELSE -1.0 END) AS v FROM e GROUP BY ALL), t AS (SELECT id, scope, avg(v) AS v FROM s GROUP BY ALL) SELECT id, round(avg(v)::DOUBLE, 6) AS fit, round(min(v)::DOUBLE, 6) AS worst FROM t GROUP BY id""")
def scope_fit(spark: SparkSession, d: str) -> DataFrame:
    """Best alternative of a group, mean over a scope's groups, then over scopes."""
    v = F.when(F.col("state") == "match", 1.0).when(F.col("state") == "unknown", 0.0).otherwise(-1.0)
    s = _states(spark, d).groupBy("id", "scope", "group").agg(F.max(v).alias("v")).groupBy("id", "scope").agg(F.avg("v").alias("v"))
    return s.groupBy("id").agg(F.round(F.avg("v"), 6).alias("fit"), F.round(F.min("v"), 6).alias("worst"))


@query("library_preference", f"""WITH {TRACKS_SQL}, clauses(c, positive, genre) AS (VALUES (1, true, 'PROMO'), (2, true, 'SMALL'), (3, false, 'LARGE')), s AS (SELECT id, positive, avg(CASE WHEN tracks.genre = clauses.genre THEN 1.0 ELSE 0 END) AS v FROM tracks, clauses GROUP BY ALL)
SELECT id, round((coalesce(max(v) FILTER (positive), 0) - coalesce(max(v) FILTER (NOT positive), 0))::DOUBLE, 6) AS score FROM s GROUP BY id""")
def library_preference(spark: SparkSession, d: str) -> DataFrame:
    """Clauses without a match stay in the denominator. Three clauses are literals of the plan."""
    hit = lambda g: F.when(F.col("genre") == g, 1.0).otherwise(0.0)
    return tracks(spark, d).select("id", F.round((hit("PROMO") + hit("SMALL")) / 2 - hit("LARGE"), 6).alias("score"))


@query("evidence_cascade", f"""WITH {TRACKS_SQL} SELECT id, coalesce(CASE WHEN id % 7 = 0 THEN 'match' END, CASE WHEN id % 5 = 0 THEN 'mismatch' END, CASE WHEN genre = 'PROMO' THEN 'match' END, 'unknown') AS state FROM tracks""")
def evidence_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first source that knows decides; unknown is null until the end."""
    i = F.col("id")
    return tracks(spark, d).select("id", F.coalesce(F.when(i % 7 == 0, "match"), F.when(i % 5 == 0, "mismatch"), F.when(F.col("genre") == "PROMO", "match"), F.lit("unknown")).alias("state"))


@query("conflicting_annotations", f"""WITH {TRACKS_SQL}, a AS (SELECT artist, CASE WHEN id * 37 % 101 < 2 THEN 'minor' ELSE 'major' END AS v FROM tracks) SELECT artist, CASE WHEN count(DISTINCT v) > 1 THEN 'unknown' WHEN bool_and(v = 'major') THEN 'match' ELSE 'mismatch' END AS state FROM a GROUP BY artist""")
def conflicting_annotations(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("id") * 37 % 101 < 2, "minor").otherwise("major")
    return tracks(spark, d).groupBy("artist").agg(F.when(F.count_distinct(v) > 1, "unknown").when(F.bool_and(v == "major"), "match").otherwise("mismatch").alias("state"))


@query("compound_genres", f"""WITH {TRACKS_SQL}, pair(compound, a, b) AS (VALUES ('promo small', 'PROMO', 'SMALL'), ('large medium', 'LARGE', 'MEDIUM')), g AS (SELECT DISTINCT artist, title, genre FROM tracks)
SELECT artist, title, compound, 0.75 AS support FROM g JOIN pair ON genre IN (a, b) GROUP BY ALL HAVING count(DISTINCT genre) = 2""")
def compound_genres(spark: SparkSession, d: str) -> DataFrame:
    """Both component tags of a compound: division over a table of pairs."""
    pair = spark.createDataFrame([("promo small", "PROMO"), ("promo small", "SMALL"), ("large medium", "LARGE"), ("large medium", "MEDIUM")], "compound string, genre string")
    return tracks(spark, d).join(F.broadcast(pair), "genre").groupBy("artist", "title", "compound").agg(F.count_distinct("genre").alias("n")).filter("n = 2").select("artist", "title", "compound", F.lit(0.75).alias("support"))


@query("candidate_caps", f"WITH {TRACKS_SQL}, r AS (SELECT id, artist, (id * 37 % 101) / 101.0 AS f, row_number() OVER (PARTITION BY artist ORDER BY (id * 37 % 101) / 101.0 DESC, id) AS k FROM tracks) SELECT id, artist, k AS rank FROM r WHERE k <= 7")
def candidate_caps(spark: SparkSession, d: str) -> DataFrame:
    """An artist's best candidates by fusion, at most a third of a list of 20."""
    from ..operators.search import ranked

    c = tracks(spark, d).select("id", "artist", (F.col("id") * 37 % 101 / 101.0).alias("f"))
    return ranked(c, ["artist"], 7, F.desc("f"), F.col("id")).select("id", "artist", "rank")


@query("request_relevance", f"WITH {TRACKS_SQL} SELECT id, greatest(CASE WHEN id % 2 = 0 THEN (id % 10) / 10.0 END, CASE WHEN id % 3 = 0 THEN (id % 7) / 7.0 END)::DOUBLE AS relevance FROM tracks")
def request_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The greatest of the evidence families that are there."""
    i = F.col("id")
    return tracks(spark, d).select("id", F.greatest(F.when(i % 2 == 0, (i % 10) / 10.0), F.when(i % 3 == 0, (i % 7) / 7.0)).alias("relevance"))


@query("reference_gate", f"""WITH {TRACKS_SQL} SELECT id FROM tracks WHERE artist IN (SELECT artist FROM tracks WHERE id = 9) OR id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 9)) OR id IN (SELECT vec_id FROM embeddings WHERE label = 3)""")
def reference_gate(spark: SparkSession, d: str) -> DataFrame:
    """Corroborated by identity, by the graph, or by sound: a union of three semi-joins."""
    t = tracks(spark, d).select("id", "artist")
    one = t.join(t.filter("id = 9").select("artist"), "artist", "left_semi").select("id")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    near = lines.join(lines.filter("l_partkey = 9").select("l_orderkey"), "l_orderkey", "left_semi").select(F.col("l_partkey").alias("id"))
    sound = table(spark, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id"))
    return t.select("id").join(one.unionByName(near).unionByName(sound).distinct(), "id", "left_semi")


@query("grounded_first", f"WITH {TRACKS_SQL} SELECT id, row_number() OVER (PARTITION BY artist ORDER BY (id % 4 = 0) DESC, id) AS position FROM tracks")
def grounded_first(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("id", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc(F.col("id") % 4 == 0), "id")).cast("long").alias("position"))


@query("fit_tiers", f"""WITH {_EV}, g AS (SELECT id, scope || g AS grp, bool_or(state = 'match') AS ok, bool_or(state = 'mismatch') AS bad FROM e GROUP BY ALL)
SELECT id, CASE WHEN bool_and(ok) THEN 'strong' WHEN NOT bool_or(bad AND NOT ok) THEN 'close' ELSE 'weak' END AS tier, coalesce(string_agg(CASE WHEN NOT ok THEN grp END, ', ' ORDER BY grp), '') AS gaps FROM g GROUP BY id""")
def fit_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    return E.fit_tier(s.select("id", F.concat("scope", F.col("group").cast("string")).alias("group"), "state"))


@query("instrumental_tracks", "SELECT l_orderkey, bool_and(l_discount - greatest(l_tax, 0.01) >= 0.02) AS instrumental FROM lineitem GROUP BY 1")
def instrumental_tracks(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines are the segments."""
    seg = F.struct(F.col("l_discount").alias("instrumental"), F.col("l_tax").alias("vocal"), F.lit(0.01).alias("other"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(seg).alias("s"))
    return g.select("l_orderkey", E.instrumental(F.col("s"), 0.02).alias("instrumental"))
