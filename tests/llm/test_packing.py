import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from melisma.llm import packing

LIBRARY = Library.from_file(packing.default_tokenizer())
TOKENIZER = packing.Tokenizer(packing.default_tokenizer())


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=60) | st.text(" \n\t'asdtREll1é\xa0ß$|<>endoftx.", max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " x", "<|", "endoftext|>", "\n", "日本"]), max_size=6).map("".join))
def test_ids_equal_the_library(text):
    assert TOKENIZER(text) == np.array(ids(text)[:-1], "<u4").tobytes()


def test_best_fit_prefers_the_fullest_bin():
    assert sorted(map(sorted, packing.best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []


def test_special_tokens_are_as_the_library_has_them():
    assert TOKENIZER("hello <|endoftext|> x") == np.array([31373, 220, 50256, 2124], "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_the_roots_plan_is_best_fit_decreasing(counts):
    runs = packing.root_plan(counts, 40)
    sequences = {}
    for size, lo, hi, each, at, before in runs:
        for rank in range(lo, hi):
            sequences.setdefault(at + (rank - lo) // each, []).append((before + (rank - lo) % each * size, size))
    for members in sequences.values():
        assert [a for a, _ in sorted(members)] == np.cumsum([0, *(s for _, s in sorted(members))])[:-1].tolist() and sum(s for _, s in members) <= 40
    items = [s for s, n in counts.items() for _ in range(n)]
    want = sorted(sorted(items[i] for i in b) for b in packing.best_fit(items, 40))
    assert sorted(sorted(s for _, s in m) for m in sequences.values()) == want


def whole(spark, docs, rows, limit=2048):
    want = {}
    for d, t in docs:
        i = ids(t)
        want.setdefault(d, []).append(i)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for r in rows:
        if "ids" in r:
            assert len(r.ids) == 4 * r.length
    for d, texts in want.items():
        left = []
        for i in texts:
            n = len(i)
            cuts = [0, n] if n <= limit else [0, *range(n % limit or limit, n + 1, limit)]
            left += [(k, a, b - a, zlib.crc32(np.array(i[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, zlib.crc32(r.ids) if "ids" in r else r.ids_crc32) for r in got[d]) == sorted(left)
    return len(by), sum(len(i) for t in want.values() for i in t)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "word " * 9000), (5, "x " * 2047), (6, "x " * 2048), (None, "tail")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, size int")
    whole(spark, docs, packing.pack(df).collect())
    assert packing.pack(df.limit(0)).count() == 0


def test_rounds_and_the_root(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_ITEMS", 20)
    docs = [(k, "a " * (k * 37 % 61 + 1)) for k in range(400)]
    bins, tokens = whole(spark, docs, packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), limit=64).collect(), 64)
    assert bins <= 1.06 * -(-tokens // 64) + 1
    big = [(k, "a " * 39) for k in range(300)]  # no two fit together
    assert whole(spark, big, packing.pack(spark.createDataFrame(big, "doc_id long, text string").repartition(5), limit=64).collect(), 64)[0] == 300


def test_query_packs_tightly(spark):
    sf = "/root/testdata/sf0.01"
    rows = packing.op7_hierarchical_packing(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bins, tokens = whole(spark, docs, rows)
    assert bins <= 1.02 * -(-tokens // 2048) + 1
