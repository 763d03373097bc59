import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.feistel(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    if n > 100:
        assert (p != np.arange(n)).mean() > 0.9 and (sharding.feistel(np.arange(n), n, seed=1) != p).any()


def check(rows, docs, shards=16):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    digests = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.row.doc_id, *digests(r.row.text)) if "row" in r else (r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "ä"), (3, "ä"), (3, "b"), (None, "x")] + [(7, "same")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("clash"))
    rows = sharding.shard(df, "doc_id", "text").collect()
    check(rows, docs)
    again = sharding.shard(df.repartition(5), "doc_id", "text").collect()
    assert {r.row.size for r in rows} == {"clash"} and sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(df.limit(0), "doc_id", "text").count() == 0


def test_a_row_of_very_many_copies_is_numbered_where_it_lies(spark):
    """No task numbers more of them than a partition of the input has, even where the join is a shuffled one."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, sizes = spark.conf.get(key), []
    write = sharding.Scratch.write

    def watched(self, df, name):
        out = write(self, df, name)
        if name == "repeated":
            sizes.extend(r[0] for r in out.groupBy("h", "key", "at").count().select("count").collect())
        return out

    spark.conf.set(key, "-1")
    sharding.Scratch.write = watched
    try:
        docs = [(5, "same")] * 40_000 + [(k, "x") for k in range(500)]
        check(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(16), "doc_id", "text").collect(), docs)
    finally:
        sharding.Scratch.write = write
        spark.conf.set(key, before)
    assert sum(sizes) >= 40_000 and max(sizes) <= 40_500 // 16 + 200


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    docs = [(k, f"text {k}") for k in range(500)]
    check(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect(), docs)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(sharding.op3_feistel_shards(spark, sf).collect(), docs)
