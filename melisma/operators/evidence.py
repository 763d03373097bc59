"""Evidence on candidates, which may be match, mismatch, unknown or unsupported; and filters that unknown evidence passes or fails as each rule says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH, MISMATCH, UNKNOWN = "match", "mismatch", "unknown"


def reliable(value: Column) -> Column:
    """A known value with a confidence from .6 to 1 and a provenance."""
    return F.coalesce((value["value"] != "") & value["confidence"].between(0.6, 1.0) & (value["source"] != ""), F.lit(False))


def facet(values: Column, complete: Column, wanted: Column) -> Column:
    """match if a reliable value matches; mismatch if the facet is complete and everything in it is reliable; else unknown."""
    hit = F.exists(values, lambda v: reliable(v) & (v["value"] == wanted))
    sure = complete & (F.size(values) > 0) & F.forall(values, reliable)
    return F.when(F.coalesce(hit, F.lit(False)), MATCH).when(F.coalesce(sure, F.lit(False)), MISMATCH).otherwise(UNKNOWN)


def satisfied(state: Column, exclude: Column) -> Column:
    """A hard constraint: what is asked for must match, what is excluded must be known to be absent."""
    return F.when(exclude, state == MISMATCH).otherwise(state == MATCH)


def essential(evidence: DataFrame, key: str = "id") -> DataFrame:
    """Of (id, criterion, scope, group, state): ids for which every playlist group has a match, and some journey stage matches if there are stages."""
    groups = evidence.groupBy(key, "scope", "group").agg(F.bool_or(F.col("state") == MATCH).alias("ok"))
    scopes = groups.groupBy(key, "scope").agg(F.bool_and("ok").alias("ok"))
    of = scopes.groupBy(key).agg(F.bool_and(F.when(F.col("scope") == "playlist", F.col("ok"))).alias("playlist"), F.bool_or(F.when(F.col("scope") != "playlist", F.col("ok"))).alias("stages"))
    return of.filter(F.coalesce("playlist", F.lit(True)) & F.coalesce("stages", F.lit(True))).select(key)


def not_contradicted(evidence: DataFrame, key: str = "id") -> DataFrame:
    """Best-available filter: only a mismatch rejects, and stages only if all of them mismatch."""
    bad = F.col("state") == MISMATCH
    of = evidence.groupBy(key, "scope").agg(F.bool_or(bad).alias("any"))
    of = of.groupBy(key).agg(F.bool_or(F.when(F.col("scope") == "playlist", F.col("any"))).alias("playlist"), F.bool_and(F.when(F.col("scope") != "playlist", F.col("any"))).alias("stages"))
    return of.filter(~F.coalesce("playlist", F.lit(False)) & ~F.coalesce("stages", F.lit(False))).select(key)


def eligible(candidates: DataFrame, *excluded: tuple[DataFrame, list[str]], key: str, order: str) -> DataFrame:
    """Candidates in none of the excluded sets, the first of each recording."""
    out = candidates
    for rows, on in excluded:
        out = out.join(rows.select(*on).distinct(), on, "left_anti")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def competition(df: DataFrame, value: str, by: list[str], constant: float = 60.0) -> DataFrame:
    """Adds estimate (constant + 1) / (constant + rank), ranks being shared by equal values and null values having none."""
    w = Window.partitionBy(*by, F.col(value).isNull()).orderBy(F.desc(value))
    return df.withColumn("estimate", F.when(F.col(value).isNotNull(), (constant + 1) / (constant + F.rank().over(w))))


def total(parts: dict[str, float], request: str, penalties: dict[str, float]) -> Column:
    """A mean of scores by fixed weights, less penalties. A score that no candidate of the request has is out; one that this candidate lacks counts as 0 with its weight."""
    over = Window.partitionBy(request)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c, w in parts.items():
        used = F.max(F.col(c).isNotNull()).over(over)
        top = top + F.when(used, F.coalesce(F.col(c), F.lit(0.0)) * w).otherwise(0.0)
        bottom = bottom + F.when(used, F.lit(w)).otherwise(0.0)
    out = F.when(bottom > 0, top / bottom).otherwise(0.0)
    for c, w in penalties.items():
        out = out - w * F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return out


def priority_blend(primary: Column, secondary: Column) -> Column:
    return F.when(secondary.isNull(), primary).otherwise((primary + 0.25 * secondary) / 1.25)


def layered_negative(explicit: Column, request: Column, history: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.least(F.lit(1.0), z(explicit) + 0.25 * z(request) + 0.0625 * z(history))


def margin(probabilities: Column, label: str) -> Column:
    """p(label) less the greatest other probability; null unless they are in [0, 1] and add up to 1 within .02."""
    values = F.map_values(probabilities)
    fine = F.forall(values, lambda p: p.between(0.0, 1.0)) & (F.abs(F.aggregate(values, F.lit(0.0), lambda a, p: a + p) - 1) <= 0.02)
    others = F.array_max(F.map_values(F.map_filter(probabilities, lambda k, v: k != label)))
    return F.when(fine & F.map_contains_key(probabilities, label), F.element_at(probabilities, label) - F.coalesce(others, F.lit(0.0)))


def state_of(margin_: Column, at: float = 0.5) -> Column:
    return F.when(margin_ >= at, MATCH).when(margin_ <= -at, MISMATCH).otherwise(UNKNOWN)


def segment_score(scores: Column, negative: Column) -> Column:
    """Mean over a recording's segments for what is wanted, the greatest for what is not."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) > 0, F.when(negative, F.array_max(scores)).otherwise(mean))


def segment_millionths(segments: Column, negative: Column, by_seconds: bool = False) -> Column:
    """segment_score of segments (score, seconds), both whole numbers, in millionths: exact, and rounded half up, so that it is the same in any order. By seconds the mean is weighted by them; none, or no seconds, is null."""
    weight = lambda s: s["seconds"] if by_seconds else F.lit(1).cast("long")
    total = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + s["score"] * weight(s))
    n = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + weight(s))
    twice = total * 2_000_000 + n
    mean = F.when(n > 0, ((twice - F.pmod(twice, 2 * n)) / (2 * n)).cast("long"))
    most = F.array_max(F.transform(segments, lambda s: s["score"])) * 1_000_000
    return F.when(F.size(segments) > 0, F.when(negative, most).otherwise(mean))


def instrumental(segments: Column, least: float = 0.05) -> Column:
    """Whether every segment (instrumental, vocal, other: similarities to each group of prompts) prefers the instrumental group by a margin. Null without segments."""
    clear = F.forall(segments, lambda s: s["instrumental"] - F.greatest(s["vocal"], s["other"]) >= least)
    return F.when(F.size(segments) > 0, clear)


def fit_tier(groups: DataFrame, key: str = "id") -> DataFrame:
    """(id, tier, gaps): strong if every group of clauses matches, close if none is contradicted, else weak; gaps names the groups that do not match. Of (id, group, state)."""
    g = groups.groupBy(key, "group").agg(F.bool_or(F.col("state") == MATCH).alias("ok"), F.bool_or(F.col("state") == MISMATCH).alias("bad"))
    of = g.groupBy(key).agg(F.bool_and("ok").alias("all"), F.bool_or(F.col("bad") & ~F.col("ok")).alias("some"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("group").cast("string")))), ", ").alias("gaps"))
    return of.select(key, F.when(F.col("all"), "strong").when(~F.col("some"), "close").otherwise("weak").alias("tier"), "gaps")
