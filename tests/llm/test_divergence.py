import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from melisma.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "lang string, source string, text string"


def plain(docs, least=3, best=200):
    """Every term of every group, in Python's numbers."""
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in docs):
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (x, t), n in df.items() if x == lang and n >= least), key=str.encode)
        sources = [s for x, s in groups if x == lang]
        share = lambda c, k=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in k) + len(k)) for t in k}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:best]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(rows)]
    return sorted(out)


def corpus(seed, n, sources=6):
    rng = random.Random(seed)
    words = ["the", "of", "The", "río", "rió", "漢字", "漢", "a", "ab", "abc", "abd", "über", "xylophonist", "xylophonists", "xylophone"] + ["".join(rng.choices("abst", k=rng.randint(1, 9))) for _ in range(80)]
    of = lambda s: [(w, 1 + (hash_of(w, s) % 7)) for w in words]
    out = []
    for _ in range(n):
        s = rng.choice(["s0"] * sources + [f"s{k}" for k in range(sources)])
        w, weights = zip(*of(s), strict=True)
        out.append((rng.choice(["en", "de"]), s, " ".join(rng.choices(w, weights, k=rng.randint(0, 25)))))
    return out


def hash_of(w, s):
    import zlib

    return zlib.crc32(f"{w}|{s}".encode())


def audited(spark, docs, **more):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], COLUMNS + ", term string, n int").repartition(3)
    return sorted(tuple(r) for r in D.audit(df, **more).collect())


def test_equals_counting_everything(spark):
    docs = corpus(1, 250)
    docs += [(None, "s0", "the the"), (None, None, "the"), ("", "s1", None), ("fr", "only", "une deux"), ("fr", "other", None), ("it", "alone", None), ("en", "silent", ""), ("en", "s0", "x" * 70_000 + " 12345 the")]
    assert audited(spark, docs) == plain(docs)
    assert audited(spark, docs, best=3) == plain(docs, best=3)
    assert audited(spark, docs, least=1) == plain(docs, least=1)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.parametrize("page,held,pairs", [(1, 1, 1), (3, 40, 5), (1000, 10**6, 10**6)])
def test_pages_and_ranges_of_any_size_give_the_same(monkeypatch, page, held, pairs):
    """The functions of the tasks, in this process: flushed tries, pages cut at borders, merged ranges, streamed leaves."""
    for name, value in (("HELD", held), ("PAIRS", pairs), ("SUMS", 4 if page == 1 else 1 << 20)):
        monkeypatch.setattr(D, name, value)
    monkeypatch.setattr(D.Counters, "pages", lambda self, lang, place, least=1, f=D.Counters.pages: f(self, lang, place, least, page))
    docs = corpus(2, 120, sources=4)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((a, b, c.encode()) for a, b, c in docs), strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["lang", "source", "text"])
    pages = [*D.counted(iter([batch.slice(0, 50)])), *D.counted(iter([batch.slice(50, 30), batch.slice(80)]))]
    for b in pages:
        terms = b.column("terms")[0].as_py()
        assert terms == sorted(terms) and b.column("at")[0].as_py() == D.key(terms[0]) and b.column("last")[0].as_py() == D.key(terms[-1])
    borders = {lang: np.array(sorted(map(D.key, (b"ab", b"b", b"st", "漢".encode()))), np.int64) for lang in ("en", "de")}
    ranged = sorted((b.to_pylist()[i] for b in D.cut(iter(pages), borders) for i in range(b.num_rows)), key=lambda r: (r["lang"], r["at"]))
    for r in ranged:
        assert all(np.searchsorted(borders[r["lang"]], D.key(t), "right") == r["at"] for t in r["terms"])
    leaves = {}
    for b in D.merged(iter([pa.RecordBatch.from_pylist(ranged, schema=D.ARROW)]), 3):
        for r in b.to_pylist():
            assert r["terms"] == sorted(r["terms"])
            at = 0
            for term, documents, width in zip(r["terms"], r["documents"], r["width"], strict=True):
                assert (r["lang"], term) not in leaves
                leaves[r["lang"], term] = documents, {r["names"][s]: n for s, n in zip(r["source"][at : at + width], r["n"][at : at + width], strict=True)}
                at += width
    df, counts = Counter(), defaultdict(Counter)
    for lang, source, text in docs:
        found = TERM.findall(text.translate(LOWER))
        df.update((lang, t.encode()) for t in set(found))
        for t in found:
            counts[lang, t.encode()][source] += 1
    assert leaves == {k: (n, dict(counts[k])) for k, n in df.items() if n >= 3}


def test_trie_keeps_any_set_of_strings_in_order():
    rng = random.Random(9)
    terms = [bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(1, 9))) for _ in range(600)]
    trie = D.Trie()
    numbers = trie.leaves(terms)
    assert trie.leaves(terms) == numbers and trie.size == len(set(terms))
    assert list(zip(*trie.walk(), strict=True)) == sorted(dict(zip(terms, numbers, strict=True)).items())
    assert D.keys_of(pa.array(terms, pa.binary()).slice(3)).tolist() == [D.key(t) for t in terms[3:]]


def test_adding_up_changes_nothing():
    c = D.Counters()
    for terms in ([b"b", b"a"], [b"a"], [b"c", b"b"]):
        leaves = np.array(c.trie.leaves(terms))
        c.number.setdefault("s", 0), c.number.setdefault("t", 1)
        c.documents.append((leaves, np.ones(len(leaves), np.int64)))
        c.uses.append((leaves, leaves % 2, leaves + 5))
    before = [b.to_pydict() for b in c.pages("x", 0)]
    c.settle()
    assert [b.to_pydict() for b in c.pages("x", 0)] == before and before[0]["terms"] == [[b"a", b"b", b"c"]] and before[0]["documents"] == [[2, 2, 1]]


def test_shares_are_exact():
    n, total = np.array([0, 5, 10**13, 7 * 10**14]), np.array([3, 7, 10**13 + 3, 8 * 10**15])
    assert D.share(n, total).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]
