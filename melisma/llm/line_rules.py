"""Line-first cleaning with SQL expressions only.

Every line is judged by itself: navigation (`a | b | c`), boilerplate, symbol clutter, shouting, and, for long lines, the lack of
any punctuation of any script. Failing lines are removed; a document that loses too large a part of its lines' bytes is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import tables

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED, MOST_LOST, LONG_LINE = 50, 50, 0.5, 60
BOILERPLATE = r"(?i)^\s*(cookie|privacy policy|terms of (use|service)|all rights reserved|copyright|subscribe|sign in|log in|read more|click here|share this|javascript is|lorem ipsum)"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(text: Column, characters: str) -> Column:
    """How often the (one-byte) characters occur."""
    out = F.lit(0)
    for c in characters:
        out = out + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return out.cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside a window of 3 words that occurs at least twice. Windows are sorted with their places, equal neighbours give the places of repeats, and each repeat covers 3 words less what the next one covers."""
    size = F.size(words)
    places = F.sequence(F.lit(1), size - 2)
    hashes = F.transform(places, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(hashes: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            n = F.size(pairs)
            same = lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == x["h"]))
            return let(
                F.array_sort(F.transform(F.filter(pairs, same), lambda x: x["p"])),
                lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("int"), lambda a, b: a + b),
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_pairs))

    return F.when(size < 4, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def line_ok(line: Column) -> Column:
    """Whether a line with a word passes."""
    length = F.octet_length(line)
    pipes = length - F.octet_length(F.replace(line, F.lit("|"), F.lit("")))
    spaces = length - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    navigation = (pipes >= 2) & (pipes * 4 >= spaces)
    clutter = occurrences(line, SYMBOLS) * 20 > length
    shouting = (length >= 20) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    unpunctuated = (F.char_length(line) > LONG_LINE) & ~line.rlike(r"\p{P}")
    return ~(navigation | clutter | shouting | unpunctuated | line.rlike(BOILERPLATE))


def clean_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept, and clean_text, the lines that pass.

    A null or empty text has no words, fails the base rule and has an empty clean_text. Repeated rows are judged each. Extra columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    d = d.select("doc_id", "t", F.filter(F.split("t", r"[ \t-\r]+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - occurrences(F.col("t"), SPACE)).cast("long").alias("word_chars"),
        occurrences(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.octet_length(F.array_join("lines", "")).alias("in_lines"),
        F.filter("lines", line_ok).alias("good"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    d = d.withColumn("clean_text", F.array_join("good", "\n"))
    lost = F.col("in_lines") - F.octet_length(F.array_join("good", ""))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (lost <= F.col("in_lines") * MOST_LOST)).alias("kept"), "clean_text")


def op10_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(tables(spark, sf_dir, "documents"), "doc_id", "text").drop("clean_text")


_COUNT = "(strlen({0}) - strlen(replace({0}, '{1}', '')))"
_SYM = lambda x: "(" + " + ".join(_COUNT.format(x, c) for c in SYMBOLS) + ")"
_BP = BOILERPLATE.replace("'", "''")
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 4)),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (
    SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1) GROUP BY rid),
x AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
    {_SYM('t')}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(list_sum(list_transform(lines, lambda v: strlen(v))), 0) AS in_lines,
    coalesce(list_sum(list_transform(list_filter(lines, lambda v: NOT (
        ({_COUNT.format('v', '|')} >= 2 AND {_COUNT.format('v', '|')} * 4 >= {_COUNT.format('v', ' ')})
        OR {_SYM('v')} * 20 > strlen(v)
        OR (strlen(v) >= 20 AND regexp_matches(v, '\\p{{Lu}}') AND NOT regexp_matches(v, '\\p{{Ll}}'))
        OR (length(v) > {LONG_LINE} AND NOT regexp_matches(v, '\\p{{P}}'))
        OR regexp_matches(v, '{_BP}'))), lambda v: strlen(v))), 0) AS good
  FROM d),
y AS (SELECT x.*, coalesce(n, 0)::BIGINT AS n_repeat_words FROM x LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED}) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED}) AND in_lines - good <= in_lines * {MOST_LOST}) AS kept
FROM y
"""
