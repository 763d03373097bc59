"""Queries of what prompts say. Prompts are the user turns of the conversations, and a request in words for every part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import prompts as P
from ..sources.tables import table
from .registry import query

#: Requests by the part's size: name, type and brand of a part in sentences that name, refuse, prefer and order them.
_REQUESTS = """CASE p_size % 6
  WHEN 0 THEN p_size || ' ' || lower(p_type) || ' tracks like ' || p_brand || ', with a ' || p_name || ' but no harsh vocals'
  WHEN 1 THEN 'from ' || p_name || ' to ' || lower(p_type) || ', mostly piano and strings'
  WHEN 2 THEN 'no ' || p_brand || ' or ' || p_name || '. ' || p_type || ' recorded in ' || (1950 + p_size)
  WHEN 3 THEN lower(p_type) || ' or ambient for a party, less aggressive, not only ' || p_name
  WHEN 4 THEN 'start with ' || p_name || ' and end with ' || lower(p_type) || ' from the ' || (1900 + p_size % 10 * 10) || 's'
  ELSE '"' || p_name || '" but without Orbital, ' || p_brand || ' or leftfield' END"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("key"), "text")
    return said.unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.expr(_REQUESTS).alias("text")))


def words(spark: SparkSession, d: str) -> DataFrame:
    """The musical words, and the catalogue's names: brands as artists, types as genres, names as recordings."""
    part, no_role = table(spark, d, "part"), F.lit(None).cast("string").alias("role")
    named = [part.select(F.col(c).alias("phrase"), F.lit(k).alias("kind"), F.lower(c).alias("concept"), no_role).distinct() for c, k in (("p_brand", "artist"), ("p_type", "genre"), ("p_name", "recording"))]
    return L.lexicon(L.musical(spark), *named)


_RE = P.PIECE.replace("'", "''")
_LIST = lambda x: ", ".join("'" + v.replace("'", "''") + "'" for v in x)
_ROWS = [(p, k, p, None) for k, w in L.TERMS.items() for p in w.split("|")] + [(p, "energy", v, None) for p, v in L.ENERGY.items()] + [(p, None, None, r) for r, w in L.ROLES.items() for p in w.split("|")]
_VALUES = ", ".join("(0, " + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in _ROWS)
_YEAR = lambda x: f"(CASE WHEN regexp_full_match({x}, '\\d{{4}}') AND {x}::INT BETWEEN 1000 AND 2999 THEN {x}::INT END)"
MATCHES_SQL = f"""
WITH RECURSIVE req AS (SELECT 'c' || conv_id || ':' || turn AS key, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'p' || p_partkey, {_REQUESTS} FROM part),
a AS (SELECT key, regexp_extract_all(coalesce(text, ''), '{_RE}', 1) AS x FROM req),
b AS (SELECT key, unnest(x) AS piece, generate_subscripts(x, 1) AS p FROM a),
c AS (SELECT *, sum(length(piece)) OVER w AS stop, lag(piece) OVER w AS prior FROM b WINDOW w AS (PARTITION BY key ORDER BY p)),
words AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY p) - 1 AS i, CASE WHEN length(piece) > 1 AND left(piece, 1) IN ('"', '“') THEN '"' ELSE replace(lower(piece), '’', '''') END AS word,
    stop - length(piece) + (left(piece, 1) IN ('"', '“'))::INT AS start, stop - (left(piece, 1) IN ('"', '“'))::INT AS stop, CASE WHEN prior IS NULL OR regexp_matches(prior, '[\\p{{L}}\\p{{N}}]') THEN '' ELSE prior END AS gap
  FROM c WHERE regexp_matches(piece, '[\\p{{L}}\\p{{N}}]')),
ahead AS (SELECT *, lead(word) OVER w AS w1, lead(word, 2) OVER w AS w2, lead(word, 3) OVER w AS w3, lead(stop) OVER w AS s1, lead(stop, 2) OVER w AS s2, lead(stop, 3) OVER w AS s3, lag(word) OVER w AS b1, lag(word, 2) OVER w AS b2, lead(gap) OVER w AS g1,
    regexp_matches(lead(gap) OVER w, '[,.;:!?\\n()"“”]') AS x1, regexp_matches(lead(gap, 2) OVER w, '[,.;:!?\\n()"“”]') AS x2, regexp_matches(lead(gap, 3) OVER w, '[,.;:!?\\n()"“”]') AS x3, regexp_extract(word, '^(\\d+)(.*)$', 1) AS digits, regexp_extract(word, '^(\\d+)(.*)$', 2) AS rest
  FROM words WINDOW w AS (PARTITION BY key ORDER BY i)),
runs AS (
  SELECT key, i, 1 AS n, word AS phrase, stop FROM ahead UNION ALL SELECT key, i, 2, word || ' ' || w1, s1 FROM ahead WHERE NOT x1 UNION ALL SELECT key, i, 3, word || ' ' || w1 || ' ' || w2, s2 FROM ahead WHERE NOT x1 AND NOT x2
  UNION ALL SELECT key, i, 4, word || ' ' || w1 || ' ' || w2 || ' ' || w3, s3 FROM ahead WHERE NOT x1 AND NOT x2 AND NOT x3),
raw AS (SELECT * FROM (VALUES {_VALUES}) t(ord, phrase, kind, concept, role)
  UNION ALL SELECT DISTINCT 1, p_brand, 'artist', lower(p_brand), NULL FROM part UNION ALL SELECT DISTINCT 2, p_type, 'genre', lower(p_type), NULL FROM part UNION ALL SELECT DISTINCT 3, p_name, 'recording', lower(p_name), NULL FROM part),
lex AS (SELECT * FROM (SELECT ord, trim(regexp_replace(lower(phrase), '[^\\p{{L}}\\p{{N}}''’&.-]+', ' ', 'g')) AS phrase, kind, concept, role FROM raw)
  QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY ord, role NULLS FIRST, kind NULLS FIRST, concept NULLS FIRST) = 1),
num AS (SELECT *, CASE WHEN length(digits) BETWEEN 1 AND 4 THEN digits::INT END AS v, {_YEAR("word")} AS y, {_YEAR("w1")} AS y1, {_YEAR("w2")} AS y2 FROM ahead),
dates AS (
  SELECT key, i, 1 AS n, stop, v AS f, v + 9 AS l FROM num WHERE rest IN ('s', '''s') AND v % 10 = 0 AND v BETWEEN 1500 AND 2990
  UNION ALL SELECT key, i, 2, s1, (v - 1) * 100 + 1, v * 100 FROM num WHERE rest IN ({_LIST(P.ORDINALS)}) AND v BETWEEN 1 AND 29 AND w1 = 'century'
  UNION ALL SELECT key, i, 2, s1, y, y1 FROM num WHERE g1 IN ('-', '–') AND y <= y1
  UNION ALL SELECT key, i, 3, s2, y, y2 FROM num WHERE w1 IN ({_LIST(P.PARTS)}) AND y <= y2
  UNION ALL SELECT key, i, 1, stop, y, y FROM num WHERE b1 = 'in' AND b2 IN ({_LIST(P.DATED)}) AND y IS NOT NULL),
dated AS (SELECT * FROM dates QUALIFY row_number() OVER (PARTITION BY key, i ORDER BY n DESC, f DESC, l DESC) = 1),
found AS (SELECT key, i, n, stop, kind, concept, role FROM runs JOIN lex USING (phrase) UNION ALL SELECT key, i, n, stop, 'period', f || ':' || l, NULL FROM dated),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY key, i ORDER BY n DESC, kind DESC NULLS LAST, concept DESC NULLS LAST, role DESC NULLS LAST) = 1),
nexts AS (SELECT b.key, b.i, min(c.i) AS j FROM best b LEFT JOIN best c ON c.key = b.key AND c.i >= b.i + b.n GROUP BY ALL),
walk AS (SELECT key, min(i) AS i FROM best GROUP BY key UNION ALL SELECT n.key, n.j FROM walk w JOIN nexts n ON n.key = w.key AND n.i = w.i WHERE n.j IS NOT NULL)
SELECT key, w.start::INTEGER AS start, b.stop::INTEGER AS stop, kind, concept, role FROM walk JOIN best b USING (key, i) JOIN words w USING (key, i)
"""


@query("lexicon_matches", MATCHES_SQL)
def lexicon_matches(spark: SparkSession, d: str) -> DataFrame:
    """All terms, periods and acting words of all prompts with their places: leftmost, longest, none over another."""
    t = P.tokens(requests(spark, d), "key", "text")
    return P.matches(t, words(spark, d), "key").join(t.select("key", "i", "start"), ["key", "i"]).select("key", "start", "stop", "kind", "concept", "role")


@query("intent_clauses")
def intent_clauses(spark: SparkSession, d: str) -> DataFrame:
    return P.atoms(requests(spark, d), words(spark, d))


@query("intent_parse")
def intent_parse(spark: SparkSession, d: str) -> DataFrame:
    return P.intents(requests(spark, d), words(spark, d))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """What a model that reads the requests of parts carelessly would say of them: everything wanted, some of it of the wrong kind, a mood nobody asked for and a period of its own."""
    clause = lambda kind, value, evidence, strength="essential": F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit("positive").alias("polarity"), F.lit(strength).alias("strength"), F.lit("playlist").alias("scope"), evidence.alias("evidence"))
    nothing = F.lit(None).cast("string")
    clauses = F.array(
        clause("genre", F.lower("p_type"), F.col("p_type")), clause("artist", F.col("p_brand"), F.col("p_brand")), clause("genre", F.col("p_name"), F.col("p_name")), clause("mood", F.lit("dark"), nothing),
        clause("period", F.lit("1990:2023"), nothing, "required"), clause("count", F.lit("99"), nothing, "required"), clause("activity", F.lit("party"), F.lit("for a party")), clause("mood", F.lit("tracks like"), F.lit("tracks like")),
    )
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.explode(clauses).alias("c")).select("key", "c.*")


@query("model_verdicts")
def model_verdicts(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    v = P.judged(answers(spark, d), P.atoms(r, words(spark, d)), r)
    return v.groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("clauses"), F.countDistinct("key").alias("prompts"))


@query("reconciled_clauses")
def reconciled_clauses(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    return P.reconciled(answers(spark, d), P.atoms(r, words(spark, d)), r)


#: Clauses of parts as they might be stored, some of which can't be: kinds, polarities, periods, names and choices.
_CLAUSES = {
    "kind": ["'genre'", "CASE WHEN p_size % 5 = 0 THEN 'rhythm' ELSE 'style' END", "'period'", "'include'", "'exclude'"],
    "value": ["lower(p_type)", "CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE p_name END", "(1950 + p_size) || ':1990'", "p_brand", "CASE WHEN p_size % 6 = 0 THEN upper(p_brand) ELSE 'nobody' END"],
    "polarity": ["'positive'", "CASE WHEN p_size % 7 = 0 THEN 'maybe' ELSE 'positive' END", "'positive'", "CASE WHEN p_size % 11 = 0 THEN 'negative' ELSE 'positive' END", "'negative'"],
    "strength": ["'essential'", "CASE WHEN p_size % 2 = 0 THEN 'essential' ELSE 'preferred' END", "'required'", "'required'", "'required'"],
    "scope": ["'playlist'", "CASE WHEN p_size % 4 = 0 THEN 'journey_end' ELSE 'playlist' END", "'playlist'", "'playlist'", "'playlist'"],
    "choice": ["CASE WHEN p_size % 13 = 0 THEN 1 END", "CASE WHEN p_size % 13 = 0 THEN 1 END", "CAST(NULL AS INT)", "CAST(NULL AS INT)", "CAST(NULL AS INT)"],
}


def stored(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join("struct(" + ", ".join(f"{v[k]} AS {name}" for name, v in _CLAUSES.items()) + ")" for k in range(5))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.explode(F.expr(f"array({rows})")).alias("c")).select("key", "c.*")


_STORED = "c AS (" + " UNION ALL ".join("SELECT p_partkey AS key, " + ", ".join(f"{v[k]} AS {name}" for name, v in _CLAUSES.items()) + " FROM part" for k in range(5)) + ")"


@query("clause_problems", f"""WITH {_STORED}, p AS (
  SELECT key, 'unknown kind' AS p FROM c WHERE kind NOT IN ({_LIST(P.KINDS)}) UNION ALL SELECT key, 'unknown polarity' FROM c WHERE polarity NOT IN ('positive', 'negative')
  UNION ALL SELECT key, 'period is no range of years' FROM c WHERE kind = 'period' AND TRY_CAST(split_part(value, ':', 1) AS INT) > TRY_CAST(split_part(value, ':', 2) AS INT)
  UNION ALL SELECT key, 'a wanted name is refused' FROM c WHERE kind IN ('include', 'start', 'via', 'destination') AND polarity = 'negative'
  UNION ALL SELECT key, 'a choice is refused or of a stage' FROM c WHERE choice IS NOT NULL AND NOT (polarity = 'positive' AND scope = 'playlist')
  UNION ALL SELECT a.key, 'a name is both wanted and refused' FROM c a JOIN c b ON a.key = b.key AND lower(a.value) = lower(b.value) AND a.kind = 'include' AND b.kind = 'exclude')
SELECT key, list_sort(list(DISTINCT p)) AS problems FROM p GROUP BY key""")
def clause_problems(spark: SparkSession, d: str) -> DataFrame:
    return P.clause_problems(stored(spark, d))


@query("single_genre", f"""WITH {_STORED}, a AS (SELECT * FROM c WHERE kind IN ('genre', 'style') AND polarity = 'positive' AND strength <> 'preferred')
SELECT key, min(lower(value)) AS genre FROM a GROUP BY key HAVING count(DISTINCT lower(value)) = 1 AND bool_and(choice IS NULL AND scope = 'playlist')""")
def single_genre(spark: SparkSession, d: str) -> DataFrame:
    """The genre that every track has to be of."""
    return P.single_genre(stored(spark, d))
