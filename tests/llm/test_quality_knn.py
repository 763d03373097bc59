import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from melisma.llm import quality_knn


def made(n):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(8)) + "."
    bad = lambda: " | ".join(word() + "$$$" for _ in range(60))
    return [(k, good() if k % 2 else bad(), k % 2) for k in range(n)]


def test_edges(spark):
    rows = made(200)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(999, 1), (0, None)], "doc_id long, quality int")
    model = quality_knn.train(docs, labels, "doc_id", "text", "quality")
    odd = spark.createDataFrame([(1, None, "l"), (2, "", "l"), (3, rows[0][1] * 50, "l"), (4, rows[1][1], "l"), (4, rows[1][1], "l")], "doc_id long, text string, label string")
    got = quality_knn.classify(odd, model, "text").orderBy("row.doc_id").collect()
    assert abs(got[0].score - model.prior) < 1e-9 and got[0].score == got[1].score
    assert got[2].predicted == 0 and [r.predicted for r in got[3:]] == [1, 1] and got[3].score == got[4].score
    assert quality_knn.classify(odd.limit(0), model, "text").count() == 0
    assert quality_knn.train(docs, labels.limit(0), "doc_id", "text", "quality") is None
    assert {r.score for r in quality_knn.classify(odd, None, "text").collect()} == {0.0}


def test_votes_are_exact():
    rng = np.random.default_rng(3)
    cos, y = rng.uniform(-1, 1, (20, 300)), rng.integers(0, 2, 300)
    for c, v in zip(cos, quality_knn.vote(cos, y.astype(float), 0.5), strict=True):
        near = sorted(range(300), key=lambda i: -c[i])[: quality_knn.NEIGHBOURS]
        w = [max(c[i], 0) ** quality_knn.SHARPNESS for i in near]
        assert abs(v - sum(a * y[i] for a, i in zip(w, near)) / sum(w)) < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_knn.op8_neighbour_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("quality") == F.col("predicted")).cast("int"))).first()
    assert n > 50 and right >= 0.93 * n


def test_query_equals_brute_force(spark):
    """Each text by itself: its terms counted one by one, its cosine with every labelled vector, and a sorted list of neighbours."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(quality_knn.remainder("doc_id", 5) != 0)
    model = quality_knn.train(spark.read.parquet(f"{sf}/documents.parquet"), labels, "doc_id", "text", "quality")
    known = {r.doc_id for r in labels.filter("quality in (0, 1)").collect() if r.doc_id in docs}
    assert len(model.labels) == len(known)  # the sample's bound is not reached here
    kinds = [slice(0, 1 << quality_knn.WORD_BITS), slice(1 << quality_knn.WORD_BITS, -2), slice(-2, None)]
    got = quality_knn.op8_neighbour_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = np.frombuffer(docs[r.doc_id].encode(), np.uint8)
        x = np.log1p(quality_knn.counts(raw, np.array([0, len(raw)]))[0].astype(float)) * model.idf
        for k in kinds:
            x[k] /= max(np.linalg.norm(x[k]), 1e-9)
        y = x @ model.directions.astype(float)
        cos = model.vectors.astype(float) @ (y / max(np.linalg.norm(y), 1e-9))
        near = sorted(range(len(cos)), key=lambda i: -cos[i])[: quality_knn.NEIGHBOURS]
        w = [max(cos[i], 0.0) ** quality_knn.SHARPNESS for i in near]
        want = (sum(a * model.labels[i] for a, i in zip(w, near)) + 1e-6 * model.prior) / (sum(w) + 1e-6)
        assert abs(r.score - want) < 2e-3 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
