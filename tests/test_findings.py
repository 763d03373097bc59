"""Queries against their SQL on small tables made for what once went wrong: ids beyond a million, ties, repeated names and keys."""

import duckdb

from melisma.functions import text as T
from melisma.operators import catalog as C
from melisma.operators import search as S
from melisma.plans import registry

from test_queries import plain


def equal(spark, d, name: str, **tables) -> int:
    """Writes tables (rows, schema) to a folder and compares a query with its SQL there, row by row; gives the number of rows."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(d))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = con.execute(registry.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    return len(got)


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def parts(ids, names=("red bolt", "hot ring", "blue ring"), brands=("Brand#1", "Brand#11", "Brand#12"), types=("PROMO", "SMALL")) -> tuple[list, str]:
    return [(i, names[i % len(names)], brands[i % len(brands)], types[i % len(types)], 1 + i % 5, 900.0 + i % 1000 / 10) for i in ids], PART


def test_overlay_keeps_tracks_whose_ids_copies_take(spark, tmp_path):
    """A million further on there are tracks already: they stay, beside the copies."""
    assert equal(spark, tmp_path, "catalog_overlay", part=parts([*range(60), *range(1_000_000, 1_000_060)])) == 126


def counted(monkeypatch, where, name: str) -> list[int]:
    """The rows of each table that a function is given."""
    seen, f = [], getattr(where, name)

    def put(df, *args, **named):
        seen.append(df.count())
        return f(df, *args, **named)

    monkeypatch.setattr(where, name, put)
    return seen


def test_resolution_of_names_that_many_rows_share(spark, tmp_path, monkeypatch):
    """Names, prefixes and all tokens, and ids that repeat. Spellings meet, not rows: 60 queries get 5 rows each to put in order, not 500."""
    names = ("red bolt", "Red  Bolt", "red bolt x", "bolt red", "hot ring", "hotter rings")
    rows = (parts(range(3000), names=names)[0] + parts([0, 50, 50, 7, 7], names=("hot ring", "ring hot"))[0], PART)
    seen = counted(monkeypatch, C, "resolution")
    assert equal(spark, tmp_path, "resolution_tiers", part=rows) == 60 * 5
    assert seen == [63 * 5]


def test_ambiguity_of_names_that_many_rows_share(spark, tmp_path, monkeypatch):
    names = ("red bolt", "red bolt x", "bolt red", "hot ring", "ring", "blue anvil")
    rows = (parts(range(3000), names=names)[0] + parts([50, 6000, 6050], names=("only one", "only one more", "red bolt"))[0], PART)
    seen = counted(monkeypatch, C, "resolution")
    assert equal(spark, tmp_path, "ambiguous_resolution", part=rows) == 62
    assert sum(seen) <= 63 * 2


def test_text_score_of_spellings_that_many_rows_share(spark, tmp_path, monkeypatch):
    names = ("red bolt", "red bolt x", "bolt red", "brand 1", "hot ring", "Brand#11 hot ring")
    rows = (parts(range(3000), names=names)[0] + parts([50, 6000, 6050], names=("only one", "only one more", "red bolt"))[0], PART)
    seen = counted(monkeypatch, S, "ranked")
    assert equal(spark, tmp_path, "metadata_text_score", part=rows) > 60 * 20
    assert sum(seen) <= 63 * 20


def test_pairs_of_recordings_that_share_spellings(spark, tmp_path, monkeypatch):
    """Copies of one spelling, spellings an edit apart, shared codes, ids that repeat; names are made comparable once a row and compared once a spelling."""
    made = []
    similar = T.very_similar
    monkeypatch.setattr(T, "very_similar", lambda a, b: made.append((str(a), str(b))) or similar(a, b))
    names, brands = ("large ring one", "Large ring  one", "large rings one", "hot bolt", "hot bold"), ("Brand#11", "Brand#12", "Brand#1")
    rows = (parts(range(0, 1500, 5), names=names, brands=brands)[0] + parts(range(100_000, 100_450), names=names[:2], brands=brands)[0] + parts([7, 7, 107], names=names)[0], PART)
    assert equal(spark, tmp_path, "same_recording_pairs", part=rows) > 1000
    assert made and not any("regexp" in x for pair in made for x in pair)


EVENTS = "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz"


def test_preferences_stream_with_many_keys(spark, tmp_path):
    """60,000 listeners and tracks, some of them missing, and kinds that are unknown. The state is gone through in the JVM and once; with a call of Python a key this took minutes."""
    import datetime
    import time

    kinds = ("purchase", "click", "error", "view", "signup", "other")
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 1001 == 0 else i % 20_011, kinds[i % 6 if i % 7 else 3], 1.0, '{"k": %d}' % (i % 3) if i % 997 else "{}", at) for i in range(60_000)]
    began = time.monotonic()
    assert equal(spark, tmp_path, "stream_preferences", events=(rows, EVENTS)) > 30_000
    assert time.monotonic() - began < 60


def test_affinity_scores_each_set_of_vectors_once(spark):
    """2,000 listeners like the same few tracks: rows are compared with each different set once, and every listener still has every row."""
    import numpy as np
    import pyarrow as pa

    from melisma.operators import taste as P

    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 4))
    liked = [(n, x[t].tolist()) for n in range(2000) for t in ((1, 2), (2, 1), (3,), (3, 3))[n % 4]] + [(9000, [1.0])]
    names, of, starts, by_length = P._sets(pa.array([n for n, _ in liked]), pa.array([v for _, v in liked], pa.list_(pa.float64())))
    assert len(names) == 2001 and len(of) == 2001 and starts.tolist() == [0, 2, 3, 4] and sorted(len(q) for _, q in by_length.values()) == [1, 3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.listener, r.id): r.affinity for r in P.affinity(spark.createDataFrame(liked, "listener long, vector array<double>"), rows, digits=6).collect()}
    want = {(n, i): max(float(u[t] @ u[i]) for t in ((1, 2), (2, 1), (3,), (3, 3))[n % 4]) for n in range(2000) for i in range(50)} | {(9000, i): None for i in range(50)}
    assert got.keys() == want.keys() and all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 6e-7 for k in want)


def test_budgets_search_once(spark, monkeypatch):
    """The candidates of all channels are found once, though three steps read them."""
    from melisma.operators import discovery as D

    found = spark.sparkContext.accumulator(0)

    def search(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, i, float(-i)) for i in range(9)], "request long, id long, score double").mapInArrow(search, "request long, id long, score double")
    assert D.budgeted([("a", df, 2), ("b", df.limit(0), 3)]).count() == 5
    assert found.value == 9
