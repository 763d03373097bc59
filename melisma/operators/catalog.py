"""Catalogue retrieval: token search, postings, resolution tiers, credits, round robins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def token_search(tracks: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose search text holds every token as a substring; the predicates reach the scan."""
    out = tracks
    for t in wanted:
        out = out.filter(F.col(column).contains(t))
    return out


def postings(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(term, key), each once: the terms of all texts."""
    return df.select(F.explode(F.array_distinct(F.flatten(F.array(*(T.tokens(T.latin_search(F.col(c))) for c in texts))))).alias("term"), key)


def all_terms(post: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys that have every term: relational division over the posting list."""
    return post.filter(F.col("term").isin(terms)).groupBy(key).agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(terms))).select(key)


def match_tier(wanted: Column, name: Column, exact: float, prefix: float, tokens: float) -> Column:
    """Exact, prefix or all-token match of normalised names; null for none."""
    all_in = F.forall(T.tokens(wanted), lambda t: name.contains(t))
    return F.when(wanted == "", None).when(name == wanted, exact).when(name.startswith(wanted), prefix).when(all_in, tokens)


def terms_inside(vocabulary: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(term, column): which of the vocabulary's terms hold which wanted ones. They meet on a wanted one's first three letters (or all, if fewer), of which every term has few."""
    grams = lambda t, n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    terms = vocabulary.select("term").distinct()
    parts = terms.select("term", F.explode(F.array_distinct(F.concat(*(grams(F.col("term"), n) for n in (1, 2, 3))))).alias("gram"))
    sought = wanted.select(column).filter(F.col(column) != "").distinct().withColumn("gram", F.substring(column, 1, 3))
    return parts.join(sought, "gram").filter(F.col("term").contains(F.col(column))).select("term", column)


def alike(names: DataFrame, wanted: DataFrame, exact: float, prefix: float, tokens: float) -> DataFrame:
    """(want, name, score) of two tables of spellings (name) and (want), those that match in some tier, each pair once. Every tier holds at least the wanted name's first token, so spellings are met through postings, not all with all."""
    w = wanted.select("want").distinct().withColumn("t0", F.get(T.tokens(F.col("want")), F.lit(0)))
    by_token = names.select("name").distinct().select("name", F.explode(F.array_distinct(T.tokens(F.col("name")))).alias("term"))
    pairs = by_token.join(terms_inside(by_token.select("term"), w.select("t0"), "t0"), "term").join(w, "t0").select("want", "name").distinct()
    return pairs.withColumn("score", match_tier(F.col("want"), F.col("name"), exact, prefix, tokens)).filter("score is not null")


def first(df: DataFrame, by: str | list[str], k: int, *order) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a group and task before the shuffle."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def metadata_score(query: Column, terms: Column, title: Column, artist: Column, display: Column) -> Column:
    """In millionths: the share of the display text's words that the terms are, and 4 for the title, 3 for artist and title, 2 inside the title, 1 inside the artist; null if a term is missing. Texts are normalised."""
    n = F.greatest(F.size(F.split(display, " ")), F.lit(1)).cast("long")
    twice = F.size(terms).cast("long") * 2_000_000 + n
    coverage = ((twice - twice % (2 * n)) / (2 * n)).cast("long")
    boost = F.when(title == query, 4).when(F.concat_ws(" ", artist, title) == query, 3).when(title.contains(query), 2).when(artist.contains(query), 1).otherwise(0)
    return F.when(F.forall(terms, lambda t: display.contains(t)), coverage + boost.cast("long") * 1_000_000)


def resolution(scored: DataFrame, query: str, key: str, keep: int = 5, gap: float = 0.02) -> DataFrame:
    """Best candidates of each query with their rank, and whether the first two are too near to tell."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("next", F.lead("score").over(w))
    return ranked.withColumn("ambiguous", F.max((F.col("rank") == 1) & (F.col("score") - F.col("next") <= gap + 1e-12)).over(Window.partitionBy(query))).filter(F.col("rank") <= keep).drop("next").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def round_robin(df: DataFrame, group: str, order: list, limit: int | None = None) -> DataFrame:
    """One row of each group, then the next of each; adds round (from 1)."""
    out = df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return out.orderBy("round", group).limit(limit) if limit else out


def latest(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key. One pass with one shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def overlay(base: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """base with the rows of newer in place of those that share its key."""
    return base.join(newer.select(key), key, "left_anti").unionByName(newer)
