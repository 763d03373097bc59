import hashlib
import re

import pytest
from pyspark.sql import functions as F

from melisma.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in wins:
                    hit |= set(range(a, a + n))
                    got |= wins[x]
        out.setdefault(d, []).append((len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


def same(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    i = spark.createDataFrame(items, "item_id long, text string")
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x[1] - x[0])
    got = {}
    for r in decontam.find_contamination(d, i).select("row.doc_id", "n_words", n_hit.alias("h"), "items").collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.h, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.h > 0))
    want = brute([x[:2] for x in docs], items)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return got


def test_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven twelve"), (2, "Solo"), (3, None), (4, ""), (5, "a b"), (1, ten + " eleven twelve"), (6, ten)]
    docs = [
        (1, None, "s"), (2, "", "s"), (3, "x " + ten.upper() + " y", "s"), (4, "nothing here", "s"), (5, "solo, and a; B!", "s"), (5, "solo, and a; B!", "s"),
        (6, "one two three four five six seven eight nine", "s"), (7, ("a " * 3000) + "b", "s"), (8, "two three four five six seven eight nine ten eleven twelve", "s"), (None, ten, "s"), (9, "ñandú one", "s"),
    ]
    got = same(spark, docs, items)
    assert got[8][0][1] == 11 and got[1] == [(0, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_no_documents_or_items(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(d, i).count() == 0
    one = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert decontam.find_contamination(one, i).collect()[0]["items"] == []


def test_blocks_of_the_benchmark_agree(spark):
    docs = [(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(60)), "s") for k in range(30)]
    items = [(k, " ".join(f"w{(k * 3 + j) % 40}" for j in range(15))) for k in range(20)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(items, "item_id long, text string")
    read = lambda df: sorted((r.row.doc_id, str(r.spans), str(r["items"])) for r in df.collect())
    assert read(decontam.find_contamination(d, i)) == read(decontam.find_contamination(d, i, block_bytes=300))
    same(spark, docs, items)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in decontam.op2_prefix_decontamination(spark, f"/root/testdata/{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").select("item_id", "text").collect()
    want = {k: v[0] for k, v in brute(docs, items).items()}
    assert got == want and any(v[4] for v in want.values())
