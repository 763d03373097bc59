"""Descent in graphs of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keeper


def closure(edges: DataFrame) -> DataFrame:
    """(child, parent) of every two nodes of edges (child, parent) of which one leads to the other, over any number of edges; no node is its own.

    Each round joins the pairs that it got last with all pairs, so that paths double: a graph of depth n takes log2(n) rounds, and cycles end by themselves. Rounds are tables in the shared folder.
    """
    keep = keeper(edges.sparkSession, "closure")
    known = keep(edges.select("child", "parent").filter("child is not null and parent is not null and child <> parent").distinct(), "0")
    last, k = known, 0
    while True:
        k += 1
        on = last.alias("a").join(known.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child"), F.col("b.parent"))
        back = known.alias("a").join(last.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child"), F.col("b.parent"))
        fresh = on.unionByName(back).filter("child <> parent").distinct().join(known, ["child", "parent"], "left_anti")
        last = keep(fresh, f"fresh{k}")
        if not last.limit(1).count():
            return known
        known = keep(known.unionByName(last), f"known{k}")


def ancestry(tagged: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, term) of tagged (id, tag): each tag and all that it descends from, once."""
    up = tagged.join(pairs, tagged["tag"] == pairs["child"]).select("id", F.col("parent").alias("term"))
    return up.unionByName(tagged.select("id", F.col("tag").alias("term"))).distinct()


def snapshot_problems(nodes: DataFrame, edges: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(problem, key) for all that is wrong with a graph of nodes (id, kind) and edges (source, target, kind); rules give the kinds of nodes that an edge of a kind leads from and to.

    An edge whose ends are missing or of another kind than its rule says is named by source, target and kind. Ends are looked up by joins: of nodes of one id only the first kind counts, and the id is a problem itself.
    """
    kinds = sorted({k for pair in rules.values() for k in pair})
    by_id = nodes.groupBy("id").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("|", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("target").cast("string"), F.lit("")), F.coalesce("kind", F.lit("")))
    problem = lambda df, what, key: df.select(F.lit(what).alias("problem"), key.alias("key"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    out = [problem(by_id.filter("n > 1"), "node more than once", key), problem(by_id.filter("id is null"), "node without an id", key), problem(by_id.filter(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))), "node of an unknown kind", key)]
    distinct = edges.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))
    out.append(problem(distinct.filter("n > 1"), "edge more than once", name))
    out.append(problem(distinct.filter("source = target"), "edge to its own node", name))
    out.append(problem(distinct.filter(~F.coalesce(F.col("kind").isin(*rules), F.lit(False))), "edge of an unknown kind", name))
    known = by_id.filter("id is not null")
    ends = distinct.join(known.select(F.col("id").alias("source"), F.col("kind").alias("from")), "source", "left").join(known.select(F.col("id").alias("target"), F.col("kind").alias("to")), "target", "left")
    out.append(problem(ends.filter("from is null"), "edge from nowhere", name))
    out.append(problem(ends.filter("to is null"), "edge to nowhere", name))
    wanted = F.create_map(*(F.lit(x) for k, (a, b) in rules.items() for x in (k, f"{a}|{b}")))
    out.append(problem(ends.filter("from is not null and to is not null").filter(wanted[F.col("kind")] != F.concat_ws("|", "from", "to")), "edge between other kinds", name))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every
