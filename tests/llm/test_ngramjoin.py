import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from melisma.llm import ngramjoin

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingled(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset([("", text or "")])
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs):
    """doc row -> (class, links), every pair with a shingle in common counted."""
    sets = [shingled(t) for _, t in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent, links = list(range(len(docs))), Counter()

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        key = (d is not None, d)
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((str(d), str(least[find(i)][1]), links[i]) for i, (d, _) in enumerate(docs))


def got(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, None), (2, ""), (3, "%%%"), (4, "%%%"), (5, "one"), (6, "ONE!"), (7, "one two three four"), (8, base), (9, base + " extra"), (10, base.upper()), (10, base.upper()),
        (11, " ".join(f"w{i}" for i in range(3, 63))), (12, " ".join(f"w{i}" for i in range(30, 90))), (None, base + " end"), (13, "a b c d e"), (14, "long " * 5000), (15, "long " * 400),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1))
    assert got(ngramjoin.similar_classes(df)) == brute(docs)
    assert ngramjoin.similar_classes(df.limit(0)).count() == 0
    kept = ngramjoin.one_of_each_class(df, ngramjoin.similar_classes(df)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 5, 7, 12, 13, 14] and len(kept) == 8


def test_blocks_and_splits_lose_nothing(spark):
    """Small limits force splits, tight nodes and blocks: a large near-copy group, and a passage that many documents share."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = []
    for k in range(90):
        w = [f"c{i}" for i in range(80)]
        w[(7 * k) % 80] = f"x{k}"
        docs.append((k, " ".join(w)))
    docs += [(1000 + k, " ".join(f"d{k}_{i}" for i in range(60)) + " " + passage) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(ngramjoin.similar_classes(df, limit=16)) == want
    assert max(x[2] for x in want) > 20


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(ngramjoin.op6_chosen_path_join(spark, sf)) == brute(docs)


def test_heavy_keys_are_joined_by_broadcast(spark):
    """Keys with many rows, few, none and a null, in one table or in none: the rows of a plain join."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).when(F.col("id") < 2999, F.col("id")).alias("k"), "id")
    values = rows.filter("k % 3 = 0").groupBy("k").agg(F.max("id").alias("most"), F.count(F.lit(1)).alias("there"))
    for some in (rows, rows.limit(0)):
        df = ngramjoin.joined(some, values, ["k"], some.count())
        want = some.join(values.drop("there"), ["k"])
        assert df.columns == want.columns and sorted(df.collect()) == sorted(want.collect())
    assert values.filter(F.col("there") > 3000 // ngramjoin.HEAVY).count() == 1
