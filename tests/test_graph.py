import random

from melisma.operators import graph as G


def plain(edges):
    out = {(a, b) for a, b in edges if a is not None and b is not None}
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return {(a, b) for a, b in out if a != b}


def test_closure_equals_its_definition(spark):
    rng = random.Random(6)
    for edges in ([(k, k + 1) for k in range(20)], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), (None, "a"), ("a", None), ("a", "b")], [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(14)], []):
        kind = "child string, parent string"
        df = spark.createDataFrame([tuple(None if x is None else str(x) for x in e) for e in edges], kind)
        got = [tuple(r) for r in G.closure(df).collect()]
        assert len(got) == len(set(got)) and set(got) == plain([tuple(None if x is None else str(x) for x in e) for e in edges])


def test_ancestry(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "child string, parent string")
    tagged = spark.createDataFrame([(1, "a"), (2, "c"), (1, "a"), (3, None)], "id int, tag string")
    assert sorted((r.id, r.term or "") for r in G.ancestry(tagged, pairs).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "c"), (3, "")]


def test_snapshot_problems(spark):
    nodes = spark.createDataFrame([("a", "artist"), ("r", "recording"), ("r", "recording"), (None, "artist"), ("x", "venue"), ("s", "recording")], "id string, kind string")
    edges = [("a", "r", "performs"), ("a", "s", "performs"), ("a", "s", "performs"), ("r", "r", "covers"), ("a", "zz", "performs"), ("zz", "r", "performs"), ("r", "a", "performs"), ("a", "r", "likes"), (None, "r", "covers"), ("r", "s", "covers")]
    got = sorted(map(tuple, G.snapshot_problems(nodes, spark.createDataFrame(edges, "source string, target string, kind string"), {"performs": ("artist", "recording"), "covers": ("recording", "recording")}).collect()))
    assert got == sorted([
        ("node more than once", "r"), ("node without an id", ""), ("node of an unknown kind", "x"), ("edge more than once", "a|s|performs"), ("edge to its own node", "r|r|covers"), ("edge of an unknown kind", "a|r|likes"),
        ("edge from nowhere", "zz|r|performs"), ("edge from nowhere", "|r|covers"), ("edge to nowhere", "a|zz|performs"), ("edge between other kinds", "r|a|performs"),
    ])


def test_a_history_is_saved_listed_read_and_deleted(spark, tmp_path):
    from melisma.sources.history import History

    h = History(spark, str(tmp_path / "h"), 4)
    rows = lambda *x: spark.createDataFrame(list(x), "id long, created long, title string, payload string")
    h.save(rows(*((k, k // 3, f"t{k}", "p" * k) for k in range(20))), 1)
    first = [tuple(r) for r in h.page(5).collect()]
    assert first == [(k, k // 3, f"t{k}") for k in (19, 18, 17, 16, 15)]
    assert [r.id for r in h.page(4, (first[-1][1], first[-1][0])).collect()] == [14, 13, 12, 11]
    h.save(rows((19, 0, "old", "q")), 5)
    h.save(rows((19, 99, "late", "q")), 4)
    h.delete(spark.createDataFrame([(18,), (777,)], "id int"), 6)
    assert [r.id for r in h.page(3).collect()] == [17, 16, 15]
    assert sorted((r.id, r.title, r.payload) for r in h.get(spark.createDataFrame([(19,), (18,), (3,), (3,)], "id long")).collect()) == [(3, "t3", "ppp"), (19, "old", "q")]
    assert "payload" not in h.page(3)._jdf.queryExecution().executedPlan().toString()


def test_parts_of_several_versions_are_merged(spark, tmp_path):
    from melisma.streaming.feedback import current, upsert

    path, want = str(tmp_path / "t"), {}
    for n, ids in enumerate([range(40), [3], [4, 5], range(0, 40, 2), [3, 4, 7, 50]]):
        upsert(spark.createDataFrame([(k, n) for k in ids], "id long, n long"), path, ["id"], "n", 8)
        want |= {k: n for k in ids}
        assert {r.id: r.n for r in current(spark, path).collect()} == want
