"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import TRACKS_SQL, table, tracks
from .registry import query


@query("identity_keys", f"""WITH {TRACKS_SQL}
SELECT id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS part, CASE WHEN id % 7 = 0 THEN 'rec:' || id WHEN id % 5 = 0 THEN 'local:' || id ELSE lower(artist) || chr(0) || lower(title) END AS key,
  artist AS shown_artist, title || ' - live' AS shown_title
FROM tracks""")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    local = F.when(F.col("id") % 5 == 0, F.concat(F.lit("local:"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    rec = F.when(F.col("id") % 7 == 0, F.concat(F.lit("rec:"), F.col("id").cast("string")))
    artist, title = T.display_parts(F.concat_ws(" - ", "artist", "title", F.lit("live")))
    return t.select("id", T.identity_part(F.col("title")).alias("part"), T.recording_key(rec, local, F.col("artist"), F.col("title")).alias("key"), artist.alias("shown_artist"), title.alias("shown_title"))


@query("search_forms", """
SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS latin, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS comparable FROM documents""")
def search_forms(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", F.md5(T.latin_search(F.col("text"))).alias("latin"), F.md5(T.comparable(F.col("text"))).alias("comparable"))


@query("semantic_keys", """
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: t NOT IN ('a','an','and','but','for','in','of','or','the','to','with')) AS t FROM benchmark),
k AS (SELECT item_id, t, list_concat([array_to_string(t, ' ')], list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), t) AS keys FROM w)
SELECT item_id, len(t)::BIGINT AS n_tokens, len(list_distinct(list_filter(keys, lambda x: x <> '')))::BIGINT AS n_keys, keys[1] AS phrase FROM k""")
def semantic_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "benchmark").select("item_id", T.semantic_tokens(F.col("text")).alias("t"))
    return x.select("item_id", F.size("t").cast("long").alias("n_tokens"), F.size(T.query_keys(F.col("t"))).cast("long").alias("n_keys"), F.get(T.query_keys(F.col("t")), F.lit(0)).alias("phrase"))


@query("recording_codes", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'us-abc-' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') ELSE 'bad' || c_custkey END AS raw,
  CASE WHEN c_custkey % 2 = 0 THEN ' ' || upper(substr(md5(c_custkey::VARCHAR),1,8) || '-0000-4000-8000-' || substr(md5(c_custkey::VARCHAR),9,12)) ELSE 'x' END AS u FROM customer),
n AS (SELECT c_custkey, CASE WHEN regexp_matches(upper(regexp_replace(raw,'[\\s-]+','','g')), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN upper(regexp_replace(raw,'[\\s-]+','','g')) ELSE '' END AS isrc,
  CASE WHEN regexp_matches(lower(trim(u)), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN lower(trim(u)) ELSE '' END AS mbid FROM c)
SELECT c_custkey, isrc, mbid, CASE WHEN mbid <> '' THEN 'mbid:' || mbid WHEN isrc <> '' THEN 'isrc:' || isrc ELSE 'fp:' || substr(sha256(c_custkey::VARCHAR || chr(0) || lower(regexp_replace(c_name, '[^\\p{L}\\p{N}]+', ' ', 'g')) || chr(0) || lower(c_mktsegment)), 1, 24) END AS identity,
  'artist:' || substr(sha256('artist' || chr(0) || lower(c_name)), 1, 24) AS entity
FROM n JOIN customer USING (c_custkey)""")
def recording_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    c = c.withColumn("raw", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("us-abc-"), F.lpad((F.col("c_custkey") % 10000000).cast("string"), 7, "0"))).otherwise(F.concat(F.lit("bad"), key)))
    h = F.md5(key.cast("binary"))
    c = c.withColumn("u", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper(F.concat(F.substring(h, 1, 8), F.lit("-0000-4000-8000-"), F.substring(h, 9, 12))))).otherwise("x"))
    c = c.select("c_custkey", "c_name", "c_mktsegment", T.isrc(F.col("raw")).alias("isrc"), T.uuid(F.col("u")).alias("mbid"))
    return c.select("c_custkey", "isrc", "mbid", T.recording_identity(F.col("mbid"), F.col("isrc"), F.lit(""), key, F.col("c_mktsegment"), F.col("c_name")).alias("identity"), T.entity_id("artist", F.col("c_name")).alias("entity"))


@query("keyed_sample", """
SELECT o_orderkey, sha256('keyed-artist-round-robin/v1' || chr(42) || repeat(chr(0), 7) || chr(0) || 'orders' || chr(0) || o_orderkey) AS priority FROM orders ORDER BY priority LIMIT 100""")
def keyed_sample(spark: SparkSession, d: str) -> DataFrame:
    """The orders of the 100 least hashes: a sample that any partitioning gives."""
    return table(spark, d, "orders").select("o_orderkey", T.keyed_priority(42, "orders", F.col("o_orderkey")).alias("priority")).orderBy("priority").limit(100)


@query("stable_ties", """
WITH h AS (SELECT s_suppkey, sha256('7' || chr(0) || s_suppkey) AS x FROM supplier)
SELECT s_suppkey, substr(x,15,2)||substr(x,13,2)||substr(x,11,2)||substr(x,9,2)||substr(x,7,2)||substr(x,5,2)||substr(x,3,2)||substr(x,1,2) AS h FROM h""")
def stable_ties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", T.stable_hash(7, F.col("s_suppkey")).alias("h"))


@query("similar_names", """
WITH p AS (SELECT p_partkey AS id, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT id, (a = b OR (least(length(a), length(b)) >= 8 AND levenshtein(a, b) <= greatest(1, greatest(length(a), length(b)) // 20))) AS very_similar,
  (levenshtein(a, b) <= 1 AND substr(a,1,1) = substr(b,1,1)) AS one_edit FROM p WHERE b IS NOT NULL""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).filter("b is not null")
    return p.select("id", T.very_similar(F.col("a"), F.col("b")).alias("very_similar"), T.one_edit(F.col("a"), F.col("b")).alias("one_edit"))


@query("umlaut_forms", """SELECT doc_id, md5(replace(replace(replace(replace(text,'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss')) AS spelt FROM documents WHERE lang = 'de'""")
def umlaut_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang = 'de'").select("doc_id", F.md5(T.umlauts(F.col("text"))).alias("spelt"))


@query("release_decades", """
SELECT (year(o_orderdate) // 10 * 10)::INTEGER AS decade, TRY_CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1, 2""")
def release_decades(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(T.year(F.col("o_orderdate").cast("string")).alias("year"))
    return o.groupBy(T.decade(F.col("year")).alias("decade"), "year").agg(F.count(F.lit(1)).alias("n"))


@query("slot_shares", """
SELECT n_nationkey, n_regionkey, (17 // 5 + CASE WHEN n_nationkey % 5 < 17 % 5 THEN 1 ELSE 0 END)::BIGINT AS slots, least(greatest(n_nationkey - 3, 0), 12)::BIGINT AS clamped,
  CASE WHEN n_nationkey + n_regionkey <= 0 THEN 0.5 ELSE n_nationkey::DOUBLE / (n_nationkey + n_regionkey) END AS audio_weight,
  2 * least(greatest((n_nationkey - 5.0) / 10.0, 0), 1) - 1 AS signed, greatest(0, abs(n_nationkey * 1000 - 9000) - 2500)::BIGINT AS outside FROM nation""")
def slot_shares(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return n.select(
        "n_nationkey", "n_regionkey", T.share(F.lit(17), F.lit(5), F.pmod(k, F.lit(5))).alias("slots"), T.clamp(k - 3, 0, 12).cast("long").alias("clamped"), T.audio_weight(k, r).alias("audio_weight"),
        T.signed_range(k.cast("double"), 5.0, 15.0).alias("signed"), T.outside((k * 1000).cast("long"), F.lit(9000), F.lit(2500)).alias("outside"),
    )


@query("tag_annotations", """
SELECT 'k' AS kind, json_extract_string(props, '$.k') AS value, count(*) AS n, count(DISTINCT user_id) AS listeners FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2""")
def tag_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Open-ended JSON tags as typed rows."""
    e = table(spark, d, "events").select("user_id", F.explode(F.from_json("props", "map<string,string>")).alias("kind", "value"))
    return e.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("listeners"))


@query("typed_metadata", f"""WITH {TRACKS_SQL}, a AS (
  SELECT id, 'year' AS kind, 1950 + id % 70 AS v FROM tracks UNION ALL SELECT id, 'tempo', 60 + id % 120 FROM tracks WHERE id % 3 <> 0 UNION ALL SELECT id, 'year', 1951 + id % 70 FROM tracks WHERE id % 11 = 0)
SELECT id, (CASE WHEN min(v) FILTER (kind = 'year') = max(v) FILTER (kind = 'year') THEN max(v) FILTER (kind = 'year') END)::BIGINT AS year, (max(v) FILTER (kind = 'tempo'))::BIGINT AS tempo, count(DISTINCT CASE WHEN kind = 'year' THEN v END) > 1 AS conflict FROM a GROUP BY id""")
def typed_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Annotations to typed columns; values that contradict each other are unknown."""
    t = tracks(spark, d)
    a = t.select("id", F.explode(F.filter(F.array(
        F.struct(F.lit("year").alias("kind"), (1950 + F.col("id") % 70).alias("v")), F.struct(F.when(F.col("id") % 3 != 0, "tempo").alias("kind"), (60 + F.col("id") % 120).alias("v")),
        F.struct(F.when(F.col("id") % 11 == 0, "year").alias("kind"), (1951 + F.col("id") % 70).alias("v")),
    ), lambda x: x["kind"].isNotNull())).alias("a")).select("id", "a.kind", "a.v")
    y = F.when(F.col("kind") == "year", F.col("v"))
    return a.groupBy("id").agg(F.when(F.min(y) == F.max(y), F.max(y)).alias("year"), F.max(F.when(F.col("kind") == "tempo", F.col("v"))).alias("tempo"), (F.count_distinct(y) > 1).alias("conflict"))


@query("style_lookup", """
WITH s(k, raw) AS (VALUES (0, 'Rock and  Roll'), (1, 'electronica'), (2, 'Techno'), (3, 'rock n roll'), (4, 'jazz')), c(raw, style) AS (VALUES ('rock and roll', 'rock & roll'), ('electronica', 'electronic'), ('rock n roll', 'rock & roll')),
t AS (SELECT p_partkey, coalesce(style, lower(regexp_replace(s.raw, '\\s+', ' ', 'g'))) AS style FROM part JOIN s ON p_partkey % 5 = k LEFT JOIN c ON c.raw = lower(regexp_replace(s.raw, '\\s+', ' ', 'g')))
SELECT p_partkey, style, style IN ('electronic', 'techno') AS electronic, style IN ('rock', 'rock & roll') AS rock, style = 'techno' AS techno FROM t""")
def style_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Spellings to one name, and matches that go from a style to its kinds only."""
    raw = F.get(F.array(*map(F.lit, ("Rock and  Roll", "electronica", "Techno", "rock n roll", "jazz"))), (F.col("p_partkey") % 5).cast("int"))
    is_ = lambda w: T.style_matches(F.lit(w), raw).alias(w)
    return table(spark, d, "part").select("p_partkey", T.canonical_style(raw).alias("style"), is_("electronic"), is_("rock"), is_("techno"))


@query("content_fingerprints", """SELECT count(DISTINCT r_name || '|' || n_name) AS n, bool_and(length(sha256(n_name)) = 64) AS hashed FROM nation JOIN region ON n_regionkey = r_regionkey""")
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(T.fingerprint("n_name", "r_name").alias("h"))
    return x.agg(F.count_distinct("h").alias("n"), F.bool_and(F.length("h") == 64).alias("hashed"))


@query("json_equality", """SELECT event_id, true AS same, coalesce(json_extract_string(props, '$.k'), '') = '' AS empty FROM events""")
def json_equality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    canon = lambda x: F.to_json(F.sort_array(F.map_entries(F.from_json(x, "map<string,string>"))))
    spaced = F.regexp_replace("props", ":", " : ")
    return e.select("event_id", canon(F.col("props")).eqNullSafe(canon(spaced)).alias("same"), (F.coalesce(F.get_json_object("props", "$.k"), F.lit("")) == "").alias("empty"))
