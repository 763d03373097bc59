"""Queries of identity, merging and graphs. Tracks get codes from their numbers, so that some are shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import identity as I
from ..sources.tables import TRACKS_SQL, table, tracks
from .registry import query

_REC = f"""{TRACKS_SQL}, rec AS (SELECT id, title, artist, duration_ms, CASE WHEN id % 3 = 0 THEN 'm' || id // 9 ELSE '' END AS mbid, CASE WHEN id % 4 = 0 THEN 'i' || id // 24 ELSE '' END AS isrc, 'f' || id % 50 AS fingerprint FROM tracks)"""


def recordings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    code = lambda c, n, every: F.when(i % every == 0, F.concat(F.lit(c), F.floor(i / n).cast("string"))).otherwise("")
    return tracks(spark, d).select("id", "title", "artist", "duration_ms", code("m", 9, 3).alias("mbid"), code("i", 24, 4).alias("isrc"), F.concat(F.lit("f"), (i % 50).cast("string")).alias("fingerprint"))


def _similar(c: str) -> str:
    a, b = (f"trim(regexp_replace(lower({t}.{c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))" for t in "ab")
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 8 AND levenshtein({a}, {b}) <= greatest(1, greatest(length({a}), length({b})) // 20)))"


_COMP = f"""WITH RECURSIVE {_REC}, k AS (SELECT id, mbid AS v FROM rec WHERE mbid <> '' UNION ALL SELECT id, isrc FROM rec WHERE isrc <> ''), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.v = b.v AND a.id <> b.id),
reach AS (SELECT id, id AS r FROM rec UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r), c AS (SELECT id, min(r) AS root FROM reach GROUP BY id)"""


def _by_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes only: fingerprints are left to identity_pairs."""
    r = recordings(spark, d).withColumn("fingerprint", F.lit(""))
    return I.components(I.identity_pairs(r), r)


@query("identity_dedup", _COMP + " SELECT id, root FROM c")
def identity_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _by_codes(spark, d)


@query("identity_groups", _COMP + " SELECT n::BIGINT AS n, count(*) AS groups FROM (SELECT root, count(*) AS n FROM c GROUP BY root) GROUP BY n")
def identity_groups(spark: SparkSession, d: str) -> DataFrame:
    return _by_codes(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


@query("same_recording_pairs", f"""WITH {_REC} SELECT a.id AS a, b.id AS b FROM rec a JOIN rec b ON a.id < b.id
WHERE (a.mbid <> '' AND a.mbid = b.mbid) OR (a.isrc <> '' AND a.isrc = b.isrc) OR (a.fingerprint = b.fingerprint AND {_similar('title')} AND {_similar('artist')} AND abs(a.duration_ms - b.duration_ms) <= greatest(3000.0, 0.02 * greatest(a.duration_ms, b.duration_ms)))""")
def same_recording_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue against itself, as two packs that are matched; each pair once."""
    r = recordings(spark, d)
    return I.identity_pairs(r, r).filter("a < b")


@query("duplicates_of", f"WITH {_REC}, t AS (SELECT * FROM rec WHERE id = 72) SELECT DISTINCT r.id FROM rec r, t WHERE r.id <> t.id AND ((t.mbid <> '' AND r.mbid = t.mbid) OR (t.isrc <> '' AND r.isrc = t.isrc))")
def duplicates_of(spark: SparkSession, d: str) -> DataFrame:
    """An OR over keys as a union of equi-joins."""
    r = recordings(spark, d)
    t = r.filter("id = 72")
    parts = [r.join(F.broadcast(t.filter(F.col(k) != "").select(k)), k, "left_semi").select("id") for k in ("mbid", "isrc")]
    return parts[0].unionByName(parts[1]).filter("id != 72").distinct()


@query("first_nonempty_merge", _COMP + """, j AS (SELECT c.root, rec.*, id % 2 AS pack FROM c JOIN rec USING (id))
SELECT root, arg_min(title, (pack, id)) FILTER (title <> '') AS title, arg_min(nullif(mbid, ''), (pack, id)) FILTER (mbid <> '') AS mbid, arg_min(nullif(isrc, ''), (pack, id)) FILTER (isrc <> '') AS isrc,
  ((count(DISTINCT title) > 1)::INT + (count(DISTINCT nullif(mbid, '')) > 1)::INT + (count(DISTINCT nullif(isrc, '')) > 1)::INT)::BIGINT AS conflicts, count(*) AS n FROM j GROUP BY root""")
def first_nonempty_merge(spark: SparkSession, d: str) -> DataFrame:
    j = recordings(spark, d).join(_by_codes(spark, d), "id").withColumn("pack", F.col("id") % 2)
    return I.merged(j, "root", ["pack", "id"], ["title", "mbid", "isrc"])


@query("id_suffixes", f"WITH {TRACKS_SQL}, r AS (SELECT id, lower(artist) AS want, row_number() OVER (PARTITION BY lower(artist) ORDER BY id) AS k FROM tracks) SELECT id, CASE WHEN k = 1 THEN want ELSE want || '-' || k END AS assigned FROM r")
def id_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return I.suffixed(tracks(spark, d).withColumn("want", F.lower("artist")), "want", ["id"]).select("id", "assigned")


@query("alias_collisions", f"WITH {TRACKS_SQL}, a AS (SELECT id, id % 3 AS pack, lower(title) AS alias FROM tracks), n AS (SELECT *, count(*) OVER (PARTITION BY alias) AS c FROM a) SELECT id, CASE WHEN c = 1 THEN alias ELSE alias || '@' || pack END AS alias FROM n")
def alias_collisions(spark: SparkSession, d: str) -> DataFrame:
    a = tracks(spark, d).select("id", (F.col("id") % 3).alias("pack"), F.lower("title").alias("a"))
    n = a.groupBy("a").agg(F.count(F.lit(1)).alias("c"))  # counted first: a name that very many share is one row
    return a.join(n, "a").select("id", F.when(F.col("c") == 1, F.col("a")).otherwise(F.concat_ws("@", "a", F.col("pack").cast("string"))).alias("alias"))


@query("known_recordings", f"""WITH {_REC}, q AS (SELECT id AS qid, 'm' || id // 9 AS mbid, 'i' || id // 24 AS isrc FROM rec WHERE id % 5 = 0), x AS (SELECT qid, id, 1 AS tier FROM q JOIN rec USING (mbid) UNION ALL SELECT qid, id, 2 FROM q JOIN rec r ON q.isrc = r.isrc WHERE r.mbid = '' OR r.mbid = q.mbid)
SELECT qid, min(id) AS id, min(tier)::INTEGER AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM x) WHERE tier = best GROUP BY qid""")
def known_recordings(spark: SparkSession, d: str) -> DataFrame:
    """MBID first, then ISRC unless the MBIDs contradict each other."""
    r = recordings(spark, d)
    i = F.col("id")
    q = r.filter("id % 5 = 0").select(i.alias("qid"), F.concat(F.lit("m"), F.floor(i / 9).cast("string")).alias("q_mbid"), F.concat(F.lit("i"), F.floor(i / 24).cast("string")).alias("q_isrc"))
    one = q.join(r, q["q_mbid"] == r["mbid"]).select("qid", "id", F.lit(1).alias("tier"))
    two = q.join(r, q["q_isrc"] == r["isrc"]).filter("mbid = '' or mbid = q_mbid").select("qid", "id", F.lit(2).alias("tier"))
    return one.unionByName(two).groupBy("qid").agg(F.min(F.struct("tier", "id")).alias("m")).select("qid", "m.id", "m.tier")


@query("metadata_overlay", f"WITH {TRACKS_SQL} SELECT t.id, coalesce(CASE WHEN l.id IS NOT NULL THEN l.title || '!' END, t.title) AS title, l.id IS NOT NULL AS local FROM tracks t LEFT JOIN (SELECT * FROM tracks WHERE id % 6 = 0) l USING (id)")
def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    local = t.filter("id % 6 = 0").select("id", F.concat("title", F.lit("!")).alias("l"))
    return t.join(local, "id", "left").select("id", F.coalesce("l", "title").alias("title"), F.col("l").isNotNull().alias("local"))


_PAIRS = "c AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS a FROM lineitem)"


@query("co_performance", f"WITH {_PAIRS} SELECT y.a AS artist, count(DISTINCT x.o) AS shared FROM c x JOIN c y ON x.o = y.o AND x.a <> y.a WHERE x.a = 3 GROUP BY y.a HAVING count(DISTINCT x.o) >= 2")
def co_performance(spark: SparkSession, d: str) -> DataFrame:
    """Artists that share recordings with an anchor: its recordings are a semi-join, and the rest is counted."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("a"))
    return c.join(c.filter("a = 3").select("o"), "o", "left_semi").filter("a != 3").groupBy(F.col("a").alias("artist")).agg(F.count_distinct("o").alias("shared")).filter("shared >= 2")


@query("similar_artists", f"WITH {_PAIRS}, p AS (SELECT x.a AS artist, y.a AS other, count(*) AS n FROM c x JOIN c y ON x.o = y.o AND x.a <> y.a GROUP BY ALL) SELECT artist, other, n, row_number() OVER (PARTITION BY artist ORDER BY n DESC, other) AS rank FROM p QUALIFY rank <= 5")
def similar_artists(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.search import ranked

    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("a")).distinct()
    p = c.join(c.withColumnRenamed("a", "other"), "o").filter("a != other").groupBy(F.col("a").alias("artist"), "other").agg(F.count(F.lit(1)).alias("n"))
    return ranked(p, ["artist"], 5, F.desc("n"), F.col("other"))


@query("graph_traversal", f"WITH {_PAIRS}, p AS (SELECT x.a AS owner, y.a AS other, count(*) AS n FROM c x JOIN c y ON x.o = y.o AND x.a <> y.a WHERE x.a IN (1, 2) GROUP BY ALL), nb AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n DESC, other) <= 4) SELECT DISTINCT owner, l_partkey AS track FROM nb JOIN lineitem ON l_suppkey = other QUALIFY row_number() OVER (PARTITION BY owner, other ORDER BY l_partkey, l_orderkey, l_linenumber) <= 3")
def graph_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Seeds to neighbours to their recordings, with a quota at each step."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("track"), "l_linenumber")
    seeds = lines.filter(F.col("a").isin(1, 2)).select("o", F.col("a").alias("owner")).distinct()
    p = lines.select("o", "a").distinct().join(seeds, "o").filter("a != owner").groupBy("owner", F.col("a").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    nb = p.withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "other"))).filter("k <= 4")
    t = nb.select("owner", "other").join(lines, F.col("other") == F.col("a")).withColumn("k", F.row_number().over(Window.partitionBy("owner", "other").orderBy("track", "o", "l_linenumber"))).filter("k <= 3")
    return t.select("owner", "track").distinct()


@query("graph_credit_subset", """WITH g AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) AS credits FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), c AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) AS credits FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
SELECT c.o, coalesce(len(list_filter(g.credits, lambda x: NOT list_contains(c.credits, x))) = 0, false) AS covered FROM c LEFT JOIN g USING (o)""")
def graph_credit_subset(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    of = lambda cond, name: lines.filter(cond).groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set("l_suppkey").alias(name))
    return of("l_quantity > 5", "c").join(of("l_linenumber <= 2", "g"), "o", "left").select("o", F.coalesce(F.size(F.array_except("g", "c")) == 0, F.lit(False)).alias("covered"))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """A graph of concepts out of the catalogue: a part's name descends from its noun, the noun from the types it comes in, and types from their first letters, one of which descends from a type, so that there is a cycle. Adjectives are influences, which are no descent."""
    p = table(spark, d, "part").select(F.lower("p_name").alias("name"), F.lower("p_type").alias("type"))
    edge = lambda child, parent, kind="subgenre": p.select(child.alias("child"), parent.alias("parent"), F.lit(kind).alias("kind"))
    noun, first = F.split_part("name", F.lit(" "), F.lit(2)), F.substring("type", 1, 1)
    cycle = p.groupBy(first.alias("child")).agg(F.min("type").alias("parent")).filter("child = 's'").select("child", "parent", F.lit("subgenre").alias("kind"))
    return edge(F.col("name"), noun).unionByName(edge(noun, F.col("type"))).unionByName(edge(F.col("type"), first)).unionByName(edge(F.col("name"), F.split_part("name", F.lit(" "), F.lit(1)), "influence")).unionByName(cycle).distinct()


_CONCEPTS = """p AS (SELECT lower(p_name) AS name, lower(p_type) AS type FROM part), e AS (SELECT name AS child, split_part(name, ' ', 2) AS parent FROM p UNION SELECT split_part(name, ' ', 2), type FROM p UNION SELECT type, type[1] FROM p UNION SELECT 's', min(type) FROM p WHERE type[1] = 's' HAVING count(*) > 0),
r(child, parent) AS (SELECT * FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON e.child = r.parent)"""


@query("genre_closure", f"WITH RECURSIVE {_CONCEPTS} SELECT child, parent FROM r WHERE child <> parent")
def genre_closure(spark: SparkSession, d: str) -> DataFrame:
    """Subgenres of any depth, cycles and all; influence is no descent."""
    return G.closure(concepts(spark, d).filter("kind = 'subgenre'"))


@query("concept_ancestry", f"WITH RECURSIVE {_CONCEPTS} SELECT DISTINCT p_partkey AS id, parent AS term FROM part JOIN r ON lower(p_name) = child UNION SELECT p_partkey, lower(p_name) FROM part")
def concept_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Posting terms of every part: its name and all that the name descends from."""
    return G.ancestry(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("tag")), genre_closure(spark, d))


@query("batch_merge_conflicts", "WITH b AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END FROM supplier) SELECT id, count(DISTINCT v) > 1 AS conflict, min(v)::INTEGER AS v FROM b GROUP BY id")
def batch_merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    b = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("v")))
    return b.groupBy("id").agg((F.count_distinct("v") > 1).alias("conflict"), F.min("v").alias("v"))


@query("performer_keys", """WITH c AS (SELECT l_orderkey AS o, l_suppkey AS a, CASE WHEN l_linenumber = 3 THEN 'engineer' ELSE 'performer' END AS role FROM lineitem) SELECT o, list_sort(list(DISTINCT lower(s_name))) AS keys FROM c JOIN supplier ON s_suppkey = a WHERE role <> 'engineer' GROUP BY o""")
def performer_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of a recording's performers; who is credited only as an engineer is none. A recording's credits are few."""
    c = table(spark, d, "lineitem").filter("l_linenumber != 3").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s_suppkey"))
    return c.join(table(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("name")), "s_suppkey").groupBy("o").agg(F.sort_array(F.collect_set("name")).alias("keys"))


@query("artist_decision", """WITH c AS (SELECT n_regionkey AS q, n_nationkey AS cand, (n_nationkey * 13) % 40 AS pop FROM nation), r AS (SELECT *, row_number() OVER w AS k, lead(pop) OVER w AS nx, count(*) OVER (PARTITION BY q) AS n FROM c WINDOW w AS (PARTITION BY q ORDER BY pop DESC, cand))
SELECT q, cand, CASE WHEN n = 1 THEN 'sole' WHEN pop >= 2 * nx THEN 'decided' WHEN pop > nx THEN 'provisional' ELSE 'tie' END AS decision FROM r WHERE k = 1""")
def artist_decision(spark: SparkSession, d: str) -> DataFrame:
    """By listeners: twice the next decides, more is provisional, as many is a tie."""
    w = Window.partitionBy("q").orderBy(F.desc("pop"), "cand")
    c = table(spark, d, "nation").select(F.col("n_regionkey").alias("q"), F.col("n_nationkey").alias("cand"), (F.col("n_nationkey") * 13 % 40).alias("pop"))
    r = c.withColumns({"k": F.row_number().over(w), "nx": F.lead("pop").over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("q"))}).filter("k = 1")
    return r.select("q", "cand", F.when(F.col("n") == 1, "sole").when(F.col("pop") >= 2 * F.col("nx"), "decided").when(F.col("pop") > F.col("nx"), "provisional").otherwise("tie").alias("decision"))
