"""Queries of library indexing: orders are files, lines their jobs, ship dates the epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query

_STATE = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' ELSE 'pending' END"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("pending")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("kind"), state.alias("state"), F.col("l_quantity").cast("long").alias("attempts"), "l_suppkey")


@query("file_status", "SELECT count(*) AS files, sum((o_orderstatus = 'F')::INT)::BIGINT AS done, sum((o_orderstatus = 'O')::INT)::BIGINT AS open, sum((o_orderstatus NOT IN ('F', 'O'))::INT)::BIGINT AS partial FROM orders")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("files"), n(s == "F").alias("done"), n(s == "O").alias("open"), n(~s.isin("F", "O")).alias("partial"))


@query("job_state_rollup", f"WITH j AS (SELECT l_orderkey AS f, {_STATE} AS s FROM lineitem), p AS (SELECT f, bool_and(s = 'done') AS all_done, bool_or(s = 'failed') AS any_failed FROM j GROUP BY f) SELECT all_done, any_failed, count(*) AS files FROM p GROUP BY ALL")
def job_state_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = jobs(spark, d).groupBy("file_id").agg(F.bool_and(F.col("state") == "done").alias("all_done"), F.bool_or(F.col("state") == "failed").alias("any_failed"))
    return p.groupBy("all_done", "any_failed").agg(F.count(F.lit(1)).alias("files"))


@query("pending_files", f"SELECT count(DISTINCT l_orderkey) AS pending FROM lineitem WHERE {_STATE} = 'pending'")
def pending_files(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).filter("state = 'pending'").agg(F.count_distinct("file_id").alias("pending"))


@query("jobs_by_state", f"SELECT l_linenumber AS kind, {_STATE} AS state, count(*) AS n, count(*) FILTER (l_quantity > 25) AS retried FROM lineitem GROUP BY ALL")
def jobs_by_state(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("attempts") > 25, 1)).alias("retried"))


@query("coverage_counts", "SELECT count(DISTINCT d.doc_id) AS files, count(DISTINCT l.doc_id) AS labelled, count(DISTINCT CASE WHEN l.quality = 1 THEN l.doc_id END) AS good FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"), "left")
    return x.agg(F.count_distinct("doc_id").alias("files"), F.count_distinct("l").alias("labelled"), F.count_distinct(F.when(F.col("quality") == 1, F.col("l"))).alias("good"))


@query("unchanged_files", f"WITH j AS (SELECT l_orderkey AS f, l_linenumber AS kind, {_STATE} AS s FROM lineitem) SELECT o_orderkey AS file_id FROM orders WHERE EXISTS (SELECT 1 FROM j WHERE f = o_orderkey AND kind = 1 AND s = 'done') AND EXISTS (SELECT 1 FROM j WHERE f = o_orderkey AND kind = 2 AND s = 'done') AND NOT EXISTS (SELECT 1 FROM j WHERE f = o_orderkey AND s = 'pending')")
def unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    """A settled job of each kind and no stale one: one pass over the jobs instead of three lookups."""
    has = lambda k: F.bool_or((F.col("kind") == k) & (F.col("state") == "done"))
    return jobs(spark, d).groupBy("file_id").agg((has(1) & has(2) & ~F.bool_or(F.col("state") == "pending")).alias("ok")).filter("ok").select("file_id")


@query("scan_diff", """WITH old AS (SELECT o_orderkey AS id, o_totalprice AS rev FROM orders WHERE o_orderkey % 10 <> 0), new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS rev FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'missing' WHEN old.rev <> new.rev THEN 'changed' ELSE 'same' END AS change FROM old FULL JOIN new ON old.id = new.id""")
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rev"))
    new = o.filter("id % 11 != 0").withColumn("rev", F.when(F.col("id") % 7 == 0, F.col("rev") + 1).otherwise(F.col("rev")))
    j = o.filter("id % 10 != 0").alias("a").join(new.alias("b"), F.col("a.id") == F.col("b.id"), "full")
    change = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "missing").when(F.col("a.rev") != F.col("b.rev"), "changed").otherwise("same")
    return j.select(F.coalesce("a.id", "b.id").alias("id"), change.alias("change"))


@query("new_jobs", "SELECT l_orderkey AS file_id, l_linenumber AS kind, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber AND o.l_returnflag = 'A') GROUP BY ALL")
def new_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    return j.join(j.filter("state = 'done'").select("file_id", "kind").distinct(), ["file_id", "kind"], "left_anti").groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("claimable_jobs", f"WITH j AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS kind, {_STATE} AS s FROM lineitem), m AS (SELECT DISTINCT f FROM j WHERE kind = 1 AND s = 'done') SELECT j.f AS file_id, kind, m.f IS NOT NULL AS ready FROM j LEFT JOIN m USING (f) WHERE s = 'pending' AND kind > 1")
def claimable_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).select("file_id", "kind", "state").distinct()
    m = j.filter("kind = 1 and state = 'done'").select("file_id", F.lit(True).alias("ready")).distinct()
    return j.filter("state = 'pending' and kind > 1").join(m, "file_id", "left").select("file_id", "kind", F.coalesce("ready", F.lit(False)).alias("ready"))


@query("epoch_finish", """WITH root_ok AS (SELECT o_custkey % 20 AS root, NOT bool_or(o_orderstatus = 'P') AS ok FROM orders GROUP BY 1) SELECT o_orderkey AS id FROM orders o JOIN root_ok r ON o_custkey % 20 = r.root WHERE (ok OR o_custkey % 20 < 5) AND o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)""")
def epoch_finish(spark: SparkSession, d: str) -> DataFrame:
    """Files not seen are gone, but only under roots that were read without failure (the first five are taken as read)."""
    o = table(spark, d, "orders").withColumn("root", F.col("o_custkey") % 20)
    ok = o.groupBy("root").agg((~F.bool_or(F.col("o_orderstatus") == "P")).alias("ok"))
    seen = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.filter("o_orderstatus = 'O'").join(ok, "root").filter("ok or root < 5").join(seen, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"))


@query("snapshot_joins", "SELECT l_returnflag, count(*) AS jobs, count(o_orderkey) AS files, count(c_custkey) AS metadata, sum(coalesce(length(c_mktsegment), 0))::BIGINT AS chars FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' LEFT JOIN customer ON c_custkey = o_custkey AND l_linenumber = 1 GROUP BY 1")
def snapshot_joins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("l_linenumber") == 1), "left")
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("jobs"), F.count("o_orderkey").alias("files"), F.count("c_custkey").alias("metadata"), F.sum(F.coalesce(F.length("c_mktsegment"), F.lit(0))).cast("long").alias("chars"))


@query("snapshot_digest", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest that no order changes: the XOR of row hashes, equal for the rows dealt anew."""
    o = table(spark, d, "orders")
    digest = lambda x: x.agg(F.bit_xor(F.xxhash64(*x.columns)).alias("h"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("ids"))
    return digest(o).join(digest(o.repartition(7, "o_custkey")).select("h"), "h").select("n", "ids")


@query("manifest_rows", f"WITH j AS (SELECT l_orderkey AS f, list(l_linenumber || ':' || {_STATE} ORDER BY l_linenumber, {_STATE}) AS jobs FROM lineitem GROUP BY 1) SELECT o_orderkey AS file_id, array_to_string(jobs, ',') AS jobs FROM orders LEFT JOIN j ON f = o_orderkey")
def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "state"))), lambda x: F.concat_ws(":", x["kind"].cast("string"), x["state"])), ",").alias("jobs"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id")).join(j, "file_id", "left")


@query("reusable_vectors", "SELECT label AS recording, min(vec_id) AS file FROM embeddings GROUP BY label")
def reusable_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("recording")).agg(F.min("vec_id").alias("file"))


@query("sampling_windows", "SELECT p_partkey, list_transform(range(0, 3), lambda i: round(p_size / 2.0 - 4.5 + 3 * i, 3)) AS starts FROM part WHERE p_size >= 9")
def sampling_windows(spark: SparkSession, d: str) -> DataFrame:
    """Three windows of 3 s about the middle."""
    return table(spark, d, "part").filter("p_size >= 9").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.round(F.col("p_size") / 2.0 - 4.5 + 3.0 * i, 3)).alias("starts"))


@query("artist_gap_window", "SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER w > 0 AND list_contains(list(l_suppkey) OVER w, l_suppkey) AS near FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def artist_gap_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey").rowsBetween(-3, -1)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return rows.withColumn("near", F.array_contains(F.collect_list("l_suppkey").over(w), F.col("l_suppkey")))
