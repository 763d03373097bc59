import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from melisma.llm import impactsearch as S

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, tf, size in counted:
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scores.append((-score, doc is not None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, q string, n int").repartition(parts)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, score int").repartition(2)
    return sorted((tuple(r) for r in S.search(d, i, **more).collect()), key=repr)


def corpus(seed, n):
    import random

    rng = random.Random(seed)
    words = ["the", "of", "and", "río", "x1", "Zed", "漢字"] + [f"w{k}" for k in range(60)]
    weights = [60, 40, 30] + [1 + 40 // (k + 1) for k in range(len(words) - 3)]
    return [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for k in range(n)], words, rng


def test_equals_scoring_everything(spark):
    docs, words, rng = corpus(5, 300)
    docs += [(7, docs[7][1]), (900, docs[7][1]), (None, docs[7][1]), (901, None), (902, ""), (903, "... !?"), (904, "w1 " * 5000)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(25)] + [("none", None), ("empty", ""), ("unknown", "qqq zzz"), ("i0", "w1 w1 the THE")]
    assert searched(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("size", [1, 64, 1000])
def test_segments_of_any_size_give_the_same(monkeypatch, size):
    """The functions of a task, in this process."""
    docs, words, rng = corpus(8, 200)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(20)]
    monkeypatch.setattr(S, "SEGMENT_POSTINGS", size)
    vocabulary = {t.encode(): i for i, t in enumerate({t for _, x in items for t in terms(x)})}
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1].encode() for d in docs], pa.binary())], names=["doc_id", "text"])
    table = list(S.forward(iter([batch.slice(0, 90), batch.slice(90)]), vocabulary))
    n, total = sum(b.num_rows for b in table), sum(sum(b.column(1).to_pylist()) for b in table)
    df = Counter(t for b in table for row in b.column(2).to_pylist() for t in row)
    asked = []
    for q, text in items:
        mine = sorted((vocabulary[t.encode()], k * S.term_weight(n, df[vocabulary[t.encode()]])) for t, k in Counter(terms(text)).items() if vocabulary[t.encode()] in df)
        asked.append((q, *(np.array(x, np.int64) for x in zip(*mine, strict=True))))
    found = [row for b in S.best_of_task(iter(table), asked, len(vocabulary), 10, n, total) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((q, -s, d) for q, s, d in found) == sorted((q, -s, d) for q, _, d, s in plain(docs, items))


def test_blocks_of_items_give_the_same(spark):
    docs, words, rng = corpus(6, 80)
    items = [(f"i{k}", " ".join(rng.choices(words, k=8))) for k in range(12)]
    assert searched(spark, docs, items, block_bytes=300) == plain(docs, items)


def test_many_copies_tie_by_id(spark):
    docs = [(k, "one two three") for k in range(3000)] + [(5000, "one two three four")]
    assert searched(spark, docs, [("a", "four one")], parts=7) == plain(docs, [("a", "four one")])


def test_stops_before_the_last_posting():
    n = 4000
    tf = np.where(np.arange(n) < 20, 50, 1)
    s = S.Segment(pa.array(range(n)), np.full(n, 100), np.full(n, 1), np.zeros(n, np.int32), tf, n, 100 * n)
    touched = []
    s.doc = type("Counted", (), {"__getitem__": lambda self, i, d=s.doc: touched.append(len(i)) or d[i]})()
    docs, _ = s.search(np.array([0]), np.array([5]), 10, 1, np.zeros(1, np.int64))
    assert docs.tolist() == list(range(10)) and sum(touched) <= 20


def test_empty_tables_and_ids_of_text(spark):
    assert searched(spark, [], [("a", "x")]) == []
    assert searched(spark, [(1, "x y"), (2, "z")], []) == []
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    i = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert [(r[0], r[1], r[2]) for r in sorted(S.search(d, i).collect())] == [(1, 1, "a"), (1, 2, "b")]


def test_very_long_lengths_are_exact():
    n = np.array([3 * 10**9, 7], np.int64)
    assert S.length_factor(n, 10**11, 10**13).tolist() == [25 + 75 * int(x) * 10**11 // 10**13 for x in n]
