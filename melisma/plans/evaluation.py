"""Queries of offline evaluation. An order is a request and playlist, its lines in order the answer, quantity the relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.tables import table
from .registry import query

_LIST = """p AS (SELECT l_orderkey AS request, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, (l_quantity::BIGINT % 4) AS gain, l_suppkey AS artist FROM lineitem),
lst AS (SELECT request, id, min(rank) AS rank FROM p GROUP BY ALL), rel AS (SELECT request, id, max(gain) AS gain FROM p GROUP BY ALL)"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("id"), "l_linenumber", "l_suppkey", (F.col("l_quantity").cast("long") % 4).alias("gain"), F.col("l_suppkey").alias("artist"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("l_linenumber", "id", "l_suppkey")).cast("long"))
    return p, p.groupBy("request", "id").agg(F.min("rank").alias("rank")), p.groupBy("request", "id").agg(F.max("gain").alias("gain"))


@query("recall_at_k", f"WITH {_LIST} SELECT l.request, CASE WHEN count(*) FILTER (gain > 0) > 0 THEN round(count(*) FILTER (gain > 0 AND rank <= 3)::DOUBLE / count(*) FILTER (gain > 0), 6) END AS recall FROM lst l JOIN rel USING (request, id) GROUP BY l.request")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    _, ranked, rel = _lists(spark, d)
    return E.ranked_metrics(ranked, rel, 3).select("request", F.round("recall", 6).alias("recall"))


@query("ndcg_at_k", f"WITH {_LIST}, j AS (SELECT request, rank, gain, row_number() OVER (PARTITION BY request ORDER BY gain DESC, id) AS ir FROM lst JOIN rel USING (request, id)), s AS (SELECT request, sum((pow(2, gain) - 1) / log2(rank + 1)) FILTER (rank <= 3) AS dcg, sum((pow(2, gain) - 1) / log2(ir + 1)) FILTER (ir <= 3) AS idcg FROM j GROUP BY 1) SELECT request, CASE WHEN idcg > 0 THEN round(coalesce(dcg, 0) / idcg, 6) END AS ndcg FROM s")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    _, ranked, rel = _lists(spark, d)
    return E.ranked_metrics(ranked, rel, 3).select("request", F.round("ndcg", 6).alias("ndcg"))


@query("playlist_diagnostics", f"WITH {_LIST}, c AS (SELECT request, artist, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT request, count(*) AS artists, max(n) AS most, sum(n)::BIGINT AS total FROM c GROUP BY 1), dup AS (SELECT request, count(*) - count(DISTINCT id) AS duplicates FROM p GROUP BY 1), tr AS (SELECT request, count(*) FILTER (artist = prev) AS adjacent FROM (SELECT request, artist, lag(artist) OVER (PARTITION BY request ORDER BY rank) AS prev FROM p) GROUP BY 1) SELECT request, duplicates, round(artists::DOUBLE / total, 6) AS diversity, round(most::DOUBLE / total, 6) AS max_share, adjacent FROM a JOIN dup USING (request) JOIN tr USING (request)")
def playlist_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    p, _, _ = _lists(spark, d)
    c = p.groupBy("request", "artist").agg(F.count(F.lit(1)).alias("n")).groupBy("request").agg(F.count(F.lit(1)).alias("artists"), F.max("n").alias("most"), F.sum("n").alias("total"))
    prev = F.lag("artist").over(Window.partitionBy("request").orderBy("rank"))
    rest = p.withColumn("same", F.col("artist") == prev).groupBy("request").agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicates"), F.count(F.when(F.col("same"), 1)).alias("adjacent"))
    return rest.join(c, "request").select("request", "duplicates", F.round(F.col("artists") / F.col("total"), 6).alias("diversity"), F.round(F.col("most") / F.col("total"), 6).alias("max_share"), "adjacent")


@query("transition_similarity", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT label, round(avg(round(list_cosine_similarity(e, p), 9)), 6) AS transition FROM v WHERE p IS NOT NULL GROUP BY label")
def transition_similarity(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import vectors as V

    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    v = e.withColumn("p", F.lag("e").over(Window.partitionBy("label").orderBy("vec_id"))).filter("p is not null")
    return v.groupBy("label").agg(F.round(F.avg(F.round(V.cosine(F.col("e"), F.col("p")), 9)), 6).alias("transition"))


@query("temporal_split", "WITH c AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT t, sum(n) OVER (ORDER BY t) - n AS before, sum(n) OVER () AS al FROM c) SELECT o_orderkey, CASE WHEN before < floor(al * 0.6) THEN 'train' WHEN before < floor(al * 0.8) THEN 'validation' ELSE 'test' END AS split FROM orders JOIN u ON o_orderdate = t")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return E.temporal_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "split")


@query("source_quality", f"WITH {_LIST} SELECT (id % 3)::BIGINT AS source, count(*) AS shown, count(*) FILTER (gain >= 2) AS good, round(avg(gain), 6) AS mean_gain FROM lst JOIN rel USING (request, id) WHERE rank <= 5 GROUP BY 1")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    _, ranked, rel = _lists(spark, d)
    return ranked.filter("rank <= 5").join(rel, ["request", "id"]).groupBy((F.col("id") % 3).alias("source")).agg(F.count(F.lit(1)).alias("shown"), F.count(F.when(F.col("gain") >= 2, 1)).alias("good"), F.round(F.avg("gain"), 6).alias("mean_gain"))


@query("mean_interval", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS low, round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS high FROM customer GROUP BY 1")
def mean_interval(spark: SparkSession, d: str) -> DataFrame:
    low, high = E.interval(F.col("c_acctbal"))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("case_aggregates", "SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice > 100000 THEN round(o_totalprice)::BIGINT END), 4) AS mean_known, count(*) AS cases, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS known FROM orders GROUP BY 1")
def case_aggregates(spark: SparkSession, d: str) -> DataFrame:
    big = F.when(F.col("o_totalprice") > 100000, F.round("o_totalprice").cast("long"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg(big), 4).alias("mean_known"), F.count(F.lit(1)).alias("cases"), F.count(big).alias("known"))


@query("safe_ratios", "SELECT n_regionkey, CASE WHEN count(*) FILTER (n_nationkey > 22) > 0 THEN count(*) FILTER (n_nationkey > 23)::DOUBLE / count(*) FILTER (n_nationkey > 22) END AS ratio FROM nation GROUP BY 1")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.try_divide(n(F.col("n_nationkey") > 23), n(F.col("n_nationkey") > 22)).alias("ratio"))


@query("cohort_counts", "SELECT role, count(DISTINCT conv_id) AS cases, count(*) AS turns FROM conversations GROUP BY 1")
def cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count_distinct("conv_id").alias("cases"), F.count(F.lit(1)).alias("turns"))


@query("ratio_gates", "WITH g AS (SELECT source, count(*) AS total, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, CASE WHEN total < 20 THEN 'insufficient' WHEN good::DOUBLE / total >= 0.85 THEN 'pass' ELSE 'fail' END AS gate FROM g")
def ratio_gates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").alias("good"))
    return g.select("source", E.gate(F.col("good"), F.col("total"), 0.85).alias("gate"))


@query("failure_bounds", """WITH RECURSIVE g AS (SELECT lang, sum(1 - quality)::BIGINT AS failures, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang),
b AS (SELECT lang, failures, n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS it FROM g UNION ALL
  SELECT lang, failures, n, CASE WHEN below > 0.05 THEN mid ELSE lo END, CASE WHEN below > 0.05 THEN hi ELSE mid END, it + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, failures + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) AS below FROM b WHERE it < 45))
SELECT lang, failures, n, CASE WHEN failures = n THEN 1.0 ELSE round((lo + hi) / 2, 6) END::DOUBLE AS upper95 FROM b WHERE it = 45""")
def failure_bounds(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("quality")).alias("failures"))
    return g.select("lang", "failures", "n", F.round(E.binomial_upper_column(F.col("failures"), F.col("n")), 6).alias("upper95"))


@query("latency_ranks", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (k = ceil(0.95 * n)) AS p95, max(value) AS most FROM r GROUP BY 1")
def latency_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rank: values are counted first, and the running count goes over a group's distinct values."""
    c = table(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    r = c.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    return r.groupBy("event_type").agg(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * 95 / 100), F.col("value"))).alias("p95"), F.max("value").alias("most"))


@query("blind_pool", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('seed' || chr(0) || doc_id)) AS position FROM (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT doc_id, 'item-' || lpad(position::VARCHAR, 4, '0') AS label FROM p")
def blind_pool(spark: SparkSession, d: str) -> DataFrame:
    """Items to judge in hashed order under neutral labels. The pool is what judges read, so it is small."""
    p = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.sha2(F.concat(F.lit("seed\0"), F.col("doc_id").cast("string")), 256).alias("h"))
    return p.select("doc_id", F.concat(F.lit("item-"), F.lpad(F.row_number().over(Window.orderBy("h")).cast("string"), 4, "0")).alias("label"))


@query("paired_relevance", f"WITH {_LIST}, m AS (SELECT request % 10 AS family, request, avg(gain) FILTER (rank % 2 = 1) AS a, avg(gain) FILTER (rank % 2 = 0) AS b FROM lst JOIN rel USING (request, id) GROUP BY ALL) SELECT family, count(*) AS pairs, round(avg(round(a - b, 9)), 6) AS delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def paired_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("delta"), 6).alias("delta"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    _, ranked, rel = _lists(spark, d)
    of = lambda r: F.avg(F.when(F.col("rank") % 2 == r, F.col("gain")))
    m = ranked.join(rel, ["request", "id"]).groupBy((F.col("request") % 10).alias("family"), "request").agg(of(1).alias("a"), of(0).alias("b"))
    return m.filter("a is not null and b is not null").select("family", "request", F.round(F.col("a") - F.col("b"), 9).alias("delta"))


@query("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Clusters are 50 groups of requests; a variant's group holds a row a cluster."""
    c = _deltas(spark, d).groupBy((F.col("family") % 2).cast("string").alias("variant"), (F.col("request") % 50).alias("cluster")).agg(F.avg("delta").alias("delta"))
    return c.groupBy("variant").applyInPandas(lambda rows: E.bootstrap(rows), "variant string, mean double, low double, high double")


@query("ablation_grid", "WITH v(variant, w) AS (VALUES ('full', 1.0), ('no_price', 0.0), ('half', 0.5)), s AS (SELECT variant, o_orderpriority AS p, avg(round(o_totalprice)::BIGINT) * w AS score, count(*) FILTER (o_orderstatus = 'P') AS violations FROM orders, v GROUP BY variant, w, p) SELECT p, variant, violations, round(score, 4)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY p ORDER BY violations, score DESC, variant) = 1")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Variants over cases, and of each case the variant of fewest violations, then of the best score. Cases are aggregated before they meet the three variants."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.avg(F.round("o_totalprice").cast("long")).alias("m"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("violations"))
    v = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(w).alias("w")) for n, w in (("full", 1.0), ("no_price", 0.0), ("half", 0.5))))
    s = g.select("p", "violations", "m", F.explode(v).alias("v")).select("p", "v.variant", "violations", (F.col("m") * F.col("v.w")).alias("s"))
    best = s.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("violations", F.desc("s"), "variant"))).filter("k = 1")
    return best.select("p", "variant", "violations", F.round("s", 4).alias("score"))


@query("leakage_audit", "WITH s AS (SELECT source AS key, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, md5(text) AS h FROM documents) SELECT h, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY h HAVING count(DISTINCT split) > 1")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    return table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


@query("exact_labels", "WITH g AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS got FROM conversations GROUP BY 1) SELECT got = ['assistant', 'system', 'user'] AS equal, count(*) AS n FROM g GROUP BY 1")
def exact_labels(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("got"))
    return g.groupBy((F.col("got") == F.array(F.lit("assistant"), F.lit("system"), F.lit("user"))).alias("equal")).agg(F.count(F.lit(1)).alias("n"))


@query("covered_blocks", "WITH b AS (SELECT l_partkey // 10 AS block, bool_or(l_returnflag = 'R') AS run, min(l_linenumber) AS size FROM lineitem GROUP BY 1) SELECT sum(size)::BIGINT AS total, sum(CASE WHEN run THEN size END)::BIGINT AS covered FROM b")
def covered_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_partkey") / 10).alias("block")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("run"), F.min("l_linenumber").alias("size"))
    return b.agg(F.sum("size").cast("long").alias("total"), F.sum(F.when(F.col("run"), F.col("size"))).cast("long").alias("covered"))


@query("starting_points", f"WITH {_LIST} SELECT count(DISTINCT request) AS requests, count(*) FILTER (rank = 1 AND gain >= 2) AS good_first, round(avg(gain) FILTER (rank = 1), 6) AS mean_first FROM lst JOIN rel USING (request, id)")
def starting_points(spark: SparkSession, d: str) -> DataFrame:
    _, ranked, rel = _lists(spark, d)
    first = F.col("rank") == 1
    return ranked.join(rel, ["request", "id"]).agg(F.count_distinct("request").alias("requests"), F.count(F.when(first & (F.col("gain") >= 2), 1)).alias("good_first"), F.round(F.avg(F.when(first, F.col("gain"))), 6).alias("mean_first"))


@query("constraint_violations", f"WITH {_LIST} SELECT count(*) FILTER (artist % 10 = 0) AS excluded, count(*) FILTER (rank > 6) AS too_long, count(DISTINCT request) AS playlists FROM p")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    p, _, _ = _lists(spark, d)
    return p.agg(F.count(F.when(F.col("artist") % 10 == 0, 1)).alias("excluded"), F.count(F.when(F.col("rank") > 6, 1)).alias("too_long"), F.count_distinct("request").alias("playlists"))


@query("corpus_builder", "WITH v AS (SELECT doc_id, source, CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 0 THEN 'bad' END AS label FROM documents JOIN labels USING (doc_id)), o AS (SELECT *, sha256('c' || chr(0) || doc_id) AS h FROM v WHERE label IS NOT NULL), one AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY h) <= 5) SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY h) <= 30 AS development FROM one")
def corpus_builder(spark: SparkSession, d: str) -> DataFrame:
    """Agreed labels, few a source, in hashed order, halved."""
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").when(F.col("quality") == 0, "bad")
    o = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").withColumn("label", label).filter("label is not null").withColumn("h", F.sha2(F.concat(F.lit("c\0"), F.col("doc_id").cast("string")), 256))
    one = o.withColumn("k", F.row_number().over(Window.partitionBy("source", "label").orderBy("h"))).filter("k <= 5")
    return one.select("doc_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("h")) <= 30).alias("development"))


_RUNS = """r AS (SELECT event_type AS phase, event_id, value AS latency, event_id % 11 <> 0 AS valid, user_id % 3 + 1 AS fields, (event_id % 2 = 0)::BIGINT + (user_id % 3 >= 1 AND event_id % 3 = 0)::BIGINT + (user_id % 3 >= 2 AND event_id % 5 = 0)::BIGINT AS good FROM events)"""


@query("intent_model_scores", f"""WITH {_RUNS} SELECT phase, count(*) AS runs, round(count(*) FILTER (valid) / count(*), 6) AS schema_rate, round(sum(CASE WHEN valid THEN good ELSE 0 END)::BIGINT / sum(fields)::BIGINT, 6) AS field_accuracy, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM r GROUP BY phase""")
def intent_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """An event is a run of the parser, its type the phase, its value the latency; a run has one to three labelled fields."""
    i, u = F.col("event_id"), F.col("user_id") % 3
    checks = F.slice(F.array(*(F.struct(F.lit(f).alias("field"), (i % n == 0).alias("ok")) for f, n in (("mode", 2), ("count", 3), ("references", 5)))), F.lit(1), (u + 1).cast("int"))
    runs = table(spark, d, "events").select(F.col("event_type").alias("phase"), i.alias("case"), F.col("value").alias("latency"), (i % 11 != 0).alias("valid"), checks.alias("checks"))
    return E.intent_scores(runs).select("phase", "runs", F.round("schema_rate", 6).alias("schema_rate"), F.round("field_accuracy", 6).alias("field_accuracy"), "p50", "p95")
