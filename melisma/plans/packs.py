"""Queries of packs, of samples that are merged, of measured preferences, of a history and of graph snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import measured as M
from ..operators import sampling as S
from ..operators.prompts import atoms
from ..sources.archives import registered
from ..sources.history import History
from ..sources.scratch import folder
from ..sources.tables import table
from .prompts import requests, words
from .registry import query

SAMPLE, BEST = 100, 10


@query("pack_round_trip", "SELECT 'pages/' || page_id || '.html' AS name, strlen(coalesce(html, ''))::INTEGER AS size, sha256(coalesce(html, '')) AS sha256 FROM pages")
def pack_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All pages written as members of a pack in the shared folder, and read back by their places."""
    path = f"{folder(spark)}/pack-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    registered(spark)
    pages.write.format("pack").mode("append").save(path)
    return spark.read.format("pack").option("split", 1 << 20).load(path).select("name", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


_PRIORITY = "round(-ln((('0x' || substr(md5('7|' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / n_chars, 15)"


def samples(spark: SparkSession, d: str) -> list[DataFrame]:
    """A sample of the documents of each language, as packs would bring them; longer documents are likelier to be in it."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    of = S.bottom_k(docs, "doc_id", "n_chars", SAMPLE, 7, ["lang"])
    return [of.filter(F.col("lang") == lang) for lang in ("de", "en", "es", "fr")] + [of.filter(~F.coalesce(F.col("lang").isin("de", "en", "es", "fr"), F.lit(False)))]


@query("merged_sample", f"""WITH s AS (SELECT doc_id, lang, {_PRIORITY} AS p, n_chars FROM documents WHERE n_chars > 0), t AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS n FROM s)
SELECT doc_id, lang, round(CASE WHEN (SELECT count(*) FROM t) <= {SAMPLE} THEN 1 ELSE 1 / (1 - exp(-n_chars * (SELECT p FROM t WHERE n = {SAMPLE + 1}))) END, 6) AS stands_for FROM t WHERE n <= {SAMPLE}""")
def merged_sample(spark: SparkSession, d: str) -> DataFrame:
    """The samples of all packs merged; the SQL samples the whole table at once."""
    m = S.merged(samples(spark, d), "doc_id", "n_chars", SAMPLE)
    return S.weighted(m, "doc_id", "n_chars", SAMPLE).select("doc_id", "lang", F.round("stands_for", 6).alias("stands_for"))


#: Measures of parts: tempo by size, loudness by price, energy and danceability by number; sizes divisible by 7 have no tempo.
_MEASURES = {"bpm": "CASE WHEN p_size % 7 <> 0 THEN 60.0 + 2.5 * p_size END", "loudness": "CASE WHEN p_retailprice > 0 THEN -30.0 + (p_retailprice - 900) / 50 END", "energy": "(p_partkey % 100) / 100.0", "danceability": "(p_partkey * 7 % 100) / 100.0"}


def measured_tracks(spark: SparkSession, d: str) -> DataFrame:
    pairs = ", ".join(f"'{name}', CAST({x} AS DOUBLE)" for name, x in _MEASURES.items())
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(f"map({pairs})").alias("measures"))


@query("measured_phrases", "WITH m AS (" + " UNION ALL ".join(f"SELECT p_partkey AS id, '{k}' AS measure, ({x})::DOUBLE AS value FROM part" for k, x in _MEASURES.items()) + "), r(phrase, measure, least, most, edge) AS (VALUES "
  + ", ".join(f"('{p}', '{m}', {'NULL' if lo is None else float(lo)}::DOUBLE, {'NULL' if hi is None else float(hi)}::DOUBLE, {float(e)}::DOUBLE)" for p, m, lo, hi, e in M.RANGES)
  + f"""), w AS (SELECT r.phrase, id, greatest(0.0, 1 - greatest(coalesce(least - value, 0), coalesce(value - most, 0), 0) / edge) AS x FROM m JOIN r USING (measure) WHERE value IS NOT NULL)
SELECT phrase, id, round(x, 9) AS preference, row_number() OVER (PARTITION BY phrase ORDER BY round(x, 9) DESC, id)::INTEGER AS rank FROM w QUALIFY rank <= {BEST}""")  # fmt: skip
def measured_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The best tracks for each phrase by itself."""
    rules = M.rules(spark)
    p = M.preferences(rules.select(F.col("phrase").alias("request"), "phrase", F.lit(True).alias("wanted")), measured_tracks(spark, d), rules, BEST)
    return p.select(F.col("request").alias("phrase"), "id", "preference", "rank")


@query("measured_preferences")
def measured_preferences(spark: SparkSession, d: str) -> DataFrame:
    """The best tracks for each prompt by the moods and activities that it names."""
    a = atoms(requests(spark, d), words(spark, d)).filter(F.col("kind").isin("mood", "activity"))
    wishes = a.select(F.col("key").alias("request"), F.col("concept").alias("phrase"), (F.col("polarity") == "positive").alias("wanted")).distinct()
    return M.preferences(wishes, measured_tracks(spark, d), M.rules(spark), BEST)


@query("history_page", """WITH h AS (SELECT conv_id AS id, max(turn) AS created, CASE WHEN conv_id % 10 = 1 THEN 'again ' ELSE 'list ' END || conv_id AS title FROM conversations GROUP BY conv_id)
SELECT * FROM h WHERE id % 10 <> 3 ORDER BY created DESC, id DESC LIMIT 50""")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    """Conversations saved as records; some are saved again, by a late revision too, and some are deleted."""
    h = History(spark, f"{folder(spark)}/history-{uuid.uuid4().hex}", 8)
    turns = F.to_json(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("created"), turns.alias("payload"))
    titled = lambda word: rows.withColumn("title", F.concat(F.lit(word), F.col("id").cast("string")))
    h.save(titled("list "), 1)
    h.save(titled("again ").filter("id % 10 in (1, 3)"), 3)
    h.save(titled("late ").filter("id % 10 = 1"), 2)
    h.delete(rows.filter("id % 10 = 3"), 4)
    return h.page(50)


_RULES = {"performs": ("artist", "recording"), "covers": ("recording", "recording")}


def music_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as artists and orders as recordings, with the lines as what joins them; some of it isn't right."""
    artists = table(spark, d, "supplier").select(F.concat(F.lit("a"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 9 == 0, "band").otherwise("artist").alias("kind"))
    recordings = table(spark, d, "orders").filter("o_orderkey % 10 <> 7").select(F.concat(F.lit("r"), "o_orderkey").alias("id"), F.lit("recording").alias("kind"))
    lines = table(spark, d, "lineitem")
    performs = lines.select(F.concat(F.lit("a"), "l_suppkey").alias("source"), F.concat(F.lit("r"), "l_orderkey").alias("target"), F.lit("performs").alias("kind"))
    covers = lines.filter("l_linenumber = 1").select(F.concat(F.lit("r"), "l_orderkey").alias("source"), F.concat(F.lit("r"), F.floor(F.col("l_orderkey") / 3).cast("long")).alias("target"), F.when(F.col("l_orderkey") % 11 == 0, "samples").otherwise("covers").alias("kind"))
    return artists.unionByName(recordings), performs.unionByName(covers)


@query("snapshot_problems", """WITH n AS (SELECT 'a' || s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'band' ELSE 'artist' END AS kind FROM supplier UNION ALL SELECT 'r' || o_orderkey, 'recording' FROM orders WHERE o_orderkey % 10 <> 7),
e AS (SELECT source, target, kind, count(*) AS c FROM (SELECT 'a' || l_suppkey AS source, 'r' || l_orderkey AS target, 'performs' AS kind FROM lineitem UNION ALL SELECT 'r' || l_orderkey, 'r' || (l_orderkey // 3), CASE WHEN l_orderkey % 11 = 0 THEN 'samples' ELSE 'covers' END FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL),
x AS (SELECT e.*, source || '|' || target || '|' || e.kind AS name, a.kind AS f, b.kind AS t FROM e LEFT JOIN n a ON a.id = source LEFT JOIN n b ON b.id = target),
p AS (SELECT 'node of an unknown kind' AS problem, id AS key FROM n WHERE kind = 'band' UNION ALL SELECT 'edge more than once', name FROM x WHERE c > 1 UNION ALL SELECT 'edge to its own node', name FROM x WHERE source = target
  UNION ALL SELECT 'edge of an unknown kind', name FROM x WHERE kind = 'samples' UNION ALL SELECT 'edge from nowhere', name FROM x WHERE f IS NULL UNION ALL SELECT 'edge to nowhere', name FROM x WHERE t IS NULL
  UNION ALL SELECT 'edge between other kinds', name FROM x WHERE f IS NOT NULL AND t IS NOT NULL AND ((kind = 'performs' AND (f <> 'artist' OR t <> 'recording')) OR (kind = 'covers' AND (f <> 'recording' OR t <> 'recording'))))
SELECT problem, count(*) AS n, min(key) AS first FROM p GROUP BY problem""")
def snapshot_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a graph, counted by kind, with an example of each."""
    return G.snapshot_problems(*music_graph(spark, d), _RULES).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
