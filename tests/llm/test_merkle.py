import hashlib

import duckdb
from pyspark.sql import functions as F

from melisma.llm import merkle
from melisma.llm.store import Scratch


def trees(spark, a, b, name):
    scratch = Scratch(spark, name)
    index = {k: scratch.write(merkle.archive(x, "page_id", "url", "html"), f"index-{k}") for k, x in (("a", a), ("b", b))}
    levels = merkle.height(*index.values())
    return *(merkle.tree(x, scratch, k, levels) for k, x in index.items()), scratch


def test_equal_replicas_and_edges(spark):
    rows = [(1, "http://a", "<p>x"), (2, None, None), (3, "http://c", ""), (4, "http://d", "y" * 200_000), (5, "u", "same"), (5, "u", "same"), (None, "n", "no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("h", F.lit(2))
    a, b, scratch = trees(spark, df, df.repartition(3), "eq")
    assert merkle.root(a) == merkle.root(b) and merkle.audit(a, b, scratch).count() == 0
    index = sorted(merkle.archive(df, "page_id", "url", "html").collect(), key=lambda r: r.offset)
    at = 0
    for r in index:
        assert r.offset == at
        at += r.length
    body = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 4\r\n\r\n<p>x\r\n\r\n"
    assert hashlib.sha256(body.encode()).hexdigest() in {r.digest for r in index}
    none = trees(spark, df.limit(0), df.limit(0), "none")
    assert merkle.root(none[0]) is None and merkle.audit(*none).count() == 0


def test_corruption_loss_and_extra_records(spark):
    """Two indexes of one archive; only what differs is reported."""
    scratch = Scratch(spark, "diff")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 500).alias("html"))
    index = scratch.write(merkle.archive(pages, "page_id", "url", "html"), "index")
    worse = index.filter("record_id != 11").withColumn("digest", F.when(F.col("record_id").isin(7, 200), F.lit("0" * 64)).otherwise(F.col("digest")))
    more = index.filter("record_id = 3").select(F.lit(999).cast("long").alias("record_id"), (F.col("offset") + 1).alias("offset"), "length", "digest")
    levels = merkle.height(index)
    rows = merkle.audit(merkle.tree(index, scratch, "a", levels), merkle.tree(worse.unionByName(more), scratch, "b", levels), scratch).collect()
    assert {(r.record_id, r.status) for r in rows} == {(7, "corrupt"), (200, "corrupt"), (11, "missing"), (999, "extra")}


def test_a_lost_or_resized_record_shifts_no_other(spark):
    """The second replica is page rows, hashed whole: one record lost, one longer, one more, one changed of two of an id, and lost ones of several equal."""
    scratch = Scratch(spark, "shift")
    rows = [(i, f"http://h/{i}", str(i) * 500) for i in range(300)] + [(400, "u", "same")] * 3 + [(401, "u", "one"), (401, "u", "two"), (None, "n", "no id"), (402, "u", None)]
    other = [r for r in rows if r[0] not in (11, 7, 401, 400)] + [(7, "http://h/7", "much longer" * 900), (400, "u", "same"), (401, "u", "two"), (401, "u", "zwei"), (999, "x", "extra")]
    pages, copy = (spark.createDataFrame(x, "page_id long, url string, html string") for x in (rows, other))
    index = scratch.write(merkle.archive(pages, "page_id", "url", "html"), "index")
    placed = scratch.write(merkle.placed(merkle.archive(copy, "page_id", "url", "html"), index), "placed")
    levels = merkle.height(index, placed)
    a, b = merkle.tree(index, scratch, "a", levels), merkle.tree(placed, scratch, "b", levels)
    got = sorted((r.record_id, r.status) for r in merkle.audit(a, b, scratch).collect())
    assert got == [(7, "corrupt"), (11, "missing"), (400, "missing"), (400, "missing"), (401, "corrupt"), (999, "extra")]
    same = merkle.tree(merkle.placed(merkle.archive(pages.repartition(3), "page_id", "url", "html"), index), scratch, "same", levels)
    assert merkle.root(a) == merkle.root(same)


def test_ids_of_a_third_of_all_rows(spark, monkeypatch):
    """Rows without an id, of one id and equal rows lie in several ranges; offsets have no gap, and only what differs is reported."""
    monkeypatch.setattr(merkle, "SEGMENT_ROWS", 10)
    rows = [(None, "n", f"body {i}") for i in range(90)] + [(5, "u", "same")] * 90 + [(100 + i, "u", str(i)) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    copy = spark.createDataFrame(rows[1:88] + [(None, "n", "other")] * 2 + rows[92:], pages.schema)
    scratch = Scratch(spark, "hot")
    dealt = merkle.ranged(pages, ["page_id", "html"], scratch, "dealt")
    assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 60 and dealt.filter("page_id = 5").select("part").distinct().count() > 3
    numbers = merkle.numbered(pages, ["page_id"], ["html"], scratch, "numbers").groupBy("page_id").agg(F.sort_array(F.collect_list("k")).alias("k")).collect()
    assert all(r.k == list(range(1, len(r.k) + 1)) for r in numbers)
    index = scratch.write(merkle.archive(pages, "page_id", "url", "html"), "index")
    at = 0
    for r in sorted(index.collect(), key=lambda r: r.offset):
        assert r.offset == at
        at += r.length
    placed = scratch.write(merkle.placed(merkle.archive(copy, "page_id", "url", "html"), index), "placed")
    levels = merkle.height(index, placed)
    found = merkle.audit(merkle.tree(index, scratch, "a", levels), merkle.tree(placed, scratch, "b", levels), scratch).collect()
    assert sorted((str(r.record_id), r.status) for r in found) == [("5", "missing")] * 2 + [("None", "corrupt")] * 2 + [("None", "missing")]


def test_trees_as_high_as_the_archive(spark):
    scratch = Scratch(spark, "high")
    index = spark.createDataFrame([(k, k * (1 << 34), 10, f"{k:064d}") for k in range(40)], "record_id long, offset long, length long, digest string")
    levels = merkle.height(index)
    a, b = merkle.tree(index, scratch, "a", levels), merkle.tree(index.filter("record_id != 33"), scratch, "b", levels)
    assert a[-1].count() == 1 and levels > merkle.FILE_LEVEL and [(r.record_id, r.status) for r in merkle.audit(a, b, scratch).collect()] == [(33, "missing")]


def test_the_querys_replica_is_pages(spark):
    pages = spark.createDataFrame([(7, "u", "abc"), (48, "u", None), (13, "u", "lost"), (1, "u", "kept"), (None, "u", "kept")], "page_id long, url string, html string")
    assert {(r.page_id, r.html) for r in merkle.damaged(pages, "page_id", "html").collect()} == {(7, "?bc"), (48, "?"), (1, "kept"), (None, "kept")}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    df = merkle.op1_merkle_fixity(spark, sf)
    rel = con.execute(merkle.ORACLE)
    names = [c[0] for c in rel.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())
