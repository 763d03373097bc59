"""Properties of the operators that SQL can't tell, and edges of the others."""

import itertools
import json
import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from melisma.functions import text as T
from melisma.functions import vectors as V
from melisma.operators import assembly as A
from melisma.operators import evaluation as E
from melisma.operators import evidence as Ev
from melisma.operators import identity as I
from melisma.operators import learning as L
from melisma.operators import search as S
from melisma.operators import taste as P
from melisma.plans import registry
from melisma.sources import files


def test_imports_without_the_pipeline_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['melisma.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 100, out.stderr[-500:]


def test_topk_ties_zero_and_odd_vectors(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0]), (7, None)], "id long, vector array<double>")
    got = [tuple(r)[1:2] + (r.rank,) for r in S.nearest(rows, rows.filter("id = 1"), 2).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]
    sims = {r.id: r.c for r in rows.select("id", V.cosine(F.col("vector"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()}
    assert sims[4] is None and sims[5] is None and sims[7] is None and abs(sims[3] - 1) < 1e-12


def test_query_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)], "id long, vector array<double>")
    q = rows.filter("id < 9")
    want = sorted(map(tuple, S.nearest(rows, q, 4).drop("score").collect()))
    monkeypatch.setattr(S, "QUERY_NUMBERS", 16)
    assert sorted(map(tuple, S.nearest(rows, q, 4).drop("score").collect())) == want


def test_fusion_takes_the_best_of_a_channel(spark):
    e = spark.createDataFrame([(1, 1, "a", 1, 1, 1.0), (1, 1, "a", 1, 9, 1.0), (1, 2, "a", 1, 2, 1.0), (1, 1, "b", 1, 3, 0.0)], "request long, id long, channel string, query long, rank long, weight double")
    got = {r.id: r.fusion for r in S.fused(e).collect()}
    assert got[1] == 1 and abs(got[2] - (1 / 62) / (1 / 61 + 1 / 63)) < 1e-12


def test_turns_over_many_blocks(spark, monkeypatch):
    """Sources of unequal length with shared keys take turns, whatever the size of a block."""
    rng = random.Random(5)
    rows = [(s, k, rng.randrange(60)) for s, n in (("a", 50), ("b", 7), ("c", 23)) for k in range(n)]
    seen, turns = {}, {}
    for s, k, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        turns[s] = turns.get(s, 0) + 1
        seen.setdefault(x, []).append((turns[s], s))
    want = [(x, i + 1) for i, (_, x) in enumerate(sorted((min(v), x) for x, v in seen.items()))]
    monkeypatch.setattr(S, "TURNS", 4)
    df = spark.createDataFrame(rows, "source string, k long, id long")
    got = S.interleaved(df, "source", "k", "id")
    assert got.columns == ["source", "k", "id", "position"] and sorted((r.position, r.id) for r in got.collect()) == sorted((p, x) for x, p in want)
    assert S.interleaved(df.limit(0), "source", "k", "id").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_components_equal_search(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(25)]
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = I.components(spark.createDataFrame(pairs, "a long, b long"), spark.range(n)).collect()
    assert {r.id: r.root for r in got} == dict(enumerate(label))


def test_identity_is_closed_over_codes(spark):
    rows = [(1, "Song", "Band", 100_000, "", "i1", ""), (2, "Song", "Band", 900_000, "m1", "i1", ""), (3, "Else", "Other", 1, "m1", "", ""), (4, "A long enough title", "Some band", 200_000, "", "", "f"), (5, "A long enough titla", "Some band", 202_000, "", "", "f"), (6, "Another thing", "Some band", 200_000, "", "", "f"), (7, "Song", "Band", 100_000, "", "", "")]
    df = spark.createDataFrame(rows, "id long, title string, artist string, duration_ms long, mbid string, isrc string, fingerprint string")
    got = {r.id: r.root for r in I.components(I.identity_pairs(df), df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_facets_unknown_is_not_false(spark):
    v = "array<struct<value:string,confidence:double,source:string>>"
    rows = [(1, [("x", 0.9, "t")], False), (2, [("x", 0.5, "t")], True), (3, [("y", 0.9, "t")], True), (4, [("y", 0.9, "t")], False), (5, [], True)]
    df = spark.createDataFrame(rows, f"id long, v {v}, complete boolean")
    got = {r.id: r.s for r in df.select("id", Ev.facet(F.col("v"), F.col("complete"), F.lit("x")).alias("s")).collect()}
    assert got == {1: "match", 2: "unknown", 3: "mismatch", 4: "unknown", 5: "unknown"}


def test_feedback_last_write_wins(spark):
    rows = [(1, 1, 1, "like", 1.0, 10), (2, 1, 1, "dislike", -1.0, 20), (3, 1, 1, "accept", 0.35, 30), (4, 1, 2, "exposure", 0.0, 40)]
    e = spark.createDataFrame(rows, "sequence long, listener long, track long, kind string, weight double, said long")
    got = {(r.track, r.slot): r.kind for r in P.effective(e).collect()}
    assert got == {(1, "direct"): "dislike", (1, "review"): "accept"}


def plain_medoids(rows, most=4, apart=0.3):
    """Clusters of one listener's tracks, with all distances in memory: the first medoid has the least weighted distance to all, each next one is the farthest from those before while that is `apart` or more; tracks join the nearest, and medoids are found once more."""
    rows = rows.sort_values("track").reset_index(drop=True)
    x = np.stack(rows["vector"].to_numpy()).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    w, d = rows["w"].to_numpy(float), 1 - x @ x.T
    chosen = [int(np.argmin(np.round(d @ w, 9)))]
    while len(chosen) < min(most, len(x)):
        far = d[:, chosen].min(1)
        if round(float(far.max()), 9) < apart:
            break
        chosen.append(int(np.argmax(np.round(far, 9))))
    near = d[:, chosen].argmin(1)
    out = []
    for k in range(len(chosen)):
        own = np.flatnonzero(near == k)
        m = own[int(np.argmin(np.round(d[np.ix_(own, own)] @ w[own], 9)))]
        out.append((rows["listener"][0], int(rows["track"][m]), len(own), float(w[own].sum() / w.sum())))
    return out


def test_clusters_take_all_liked_tracks(spark):
    """A listener of 700 tracks, whose lightest ones are an interest of their own; one of two tracks; one of a single track; disliked tracks play no part."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6)) * 0.1 + np.eye(6)[rng.integers(0, 2, 700)]
    x[600:] = rng.normal(size=(100, 6)) * 0.1 + np.eye(6)[5]
    rows = [(1, t, 2.0 - t / 1000, x[t]) for t in range(700)] + [(2, 3, 1.0, x[3]), (2, 650, 0.5, x[650]), (3, 9, 1.0, x[9])]
    w = spark.createDataFrame([r[:3] for r in rows] + [(3, 10, -1.0)], "listener long, track long, w double")
    v = spark.createDataFrame([(t, x[t].tolist()) for t in range(700)], "id long, vector array<double>")
    want = []
    for n in (1, 2, 3):
        own = [r for r in rows if r[0] == n]
        want += plain_medoids(pd.DataFrame(own, columns=["listener", "track", "w", "vector"]))
    got = sorted(map(tuple, P.clusters(w, v).collect()))
    assert [g[:3] for g in got] == sorted(r[:3] for r in want)
    assert np.allclose([g[3] for g in got], [r[3] for r in sorted(want)])
    assert sum(g[2] for g in got if g[0] == 1) == 700 and any(g[0] == 1 and g[1] >= 600 for g in got)


def test_affinity_scores_every_candidate(spark, tmp_path, monkeypatch):
    """More candidates than any cap, for the query over tables of its own and for the operator in blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 4)).round(3)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = [(i, u, "purchase", f'{{"k": {t}}}') for i, (u, t) in enumerate([(1, 5), (1, 9), (2, 7)])]
    e = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    got = registry.QUERIES["listener_affinity"](spark, str(tmp_path))
    assert got.count() == 2 * 20_000 and got.select("id").distinct().count() == 20_000
    whole = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    strongest = whole.filter("id in (5, 7, 9)").select(F.when(F.col("id") == 7, 2).otherwise(1).cast("long").alias("listener"), "vector")
    got = {(r.listener, r.id) for r in P.affinity(strongest, whole, 100).collect()}
    for n, ts in {1: (5, 9), 2: (7,)}.items():
        best = np.max([u @ u[t] for t in ts], axis=0)
        mine = sorted(best[i] for k, i in got if k == n)
        assert len(mine) == 100 and np.allclose(mine, np.sort(best)[-100:], atol=1e-6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])] + [(50, [0.0] * 4), (51, [1.0])], "id long, vector array<double>")
    liked = spark.createDataFrame([(n, x[t].tolist()) for n, t in [(1, 5), (1, 9), (2, 7), (3, 8)]] + [(3, [2.0])], "listener long, vector array<double>")
    want = {(n, i): max(u[t] @ u[i] for t in ts) for n, ts in {1: (5, 9), 2: (7,), 3: (8,)}.items() for i in range(50)} | {(n, i): None for n in (1, 2, 3) for i in (50, 51)} | {(3, 51): 1.0}
    for most in (8_000_000, 8):
        monkeypatch.setattr(S, "QUERY_NUMBERS", most)
        got = {(r.listener, r.id): r.affinity for r in P.affinity(liked, rows).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-9) for k, w in want.items())


def test_affinity_returns_every_pair_once(spark, tmp_path):
    """Every listener with every candidate, the far ones too; rows that repeat an id, or have none, give one pair of it with the best of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    ids = [*range(290), 150, 150, 151, 289, *[None] * 6]
    spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    liked = {1: (5, 9), 2: (7,), None: (3,)}
    events = [(i, u, "purchase", f'{{"k": {t}}}') for i, (u, t) in enumerate((u, t) for u, ts in liked.items() for t in ts)]
    e = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    want = {}
    for n, ts in liked.items():
        for i, c in zip(ids, np.max([u @ u[t] for t in ts], axis=0), strict=True):
            want[n, i] = max(c, want.get((n, i), -2.0))
    rows = registry.QUERIES["listener_affinity"](spark, str(tmp_path)).collect()
    got = {(r.listener, r.id): r.affinity for r in rows}
    assert len(rows) == len(want) == 3 * 291 and got.keys() == want.keys() and all(abs(got[k] - w) < 2e-6 for k, w in want.items())
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vector array<double>")
    best = P.affinity(spark.createDataFrame([(2, x[7].tolist())], "listener long, vector array<double>"), vectors, 285).collect()
    mine = sorted((c for (n, _), c in want.items() if n == 2), reverse=True)[:285]
    assert len(best) == 285 and np.allclose(sorted((r.affinity for r in best), reverse=True), mine, atol=2e-6)


def test_temporal_split_keeps_ties_together(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([1, 2, 2, 3, 3])], "id long, t long")
    got = {r.id: r.split for r in E.temporal_split(df, "t").collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "validation", 4: "validation"}


def test_binomial_bound():
    assert abs(E.binomial_upper(0, 10) - (1 - 0.05 ** (1 / 10))) < 1e-9 and E.binomial_upper(3, 3) == 1
    p = E.binomial_upper(2, 30)
    assert abs(sum(math.comb(30, i) * p**i * (1 - p) ** (30 - i) for i in range(3)) - 0.05) < 1e-9


def some_pool(seed, n=24):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "total": rng.uniform(0, 1, n).round(3), "artist": rng.integers(0, 6, n), "album": [None if k % 4 == 0 else int(k % 3) for k in range(n)], "vector": list(rng.normal(size=(n, 5))), "title": np.arange(n) % 20})


@pytest.mark.parametrize("seed", range(8))
def test_selection_equals_the_plain_rule(seed):
    """A slow reading of the rule, from scratch for every pick."""
    rows = some_pool(seed)
    total, art, alb = rows.total.to_numpy(), rows.artist.tolist(), rows.album.tolist()
    x = np.stack(rows.vector)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = total.max()
    floor = max(0.05, best - 0.8)
    lam, got = 1 - 0.45 * 0.5, []
    while len(got) < 10:
        def value(i):
            rel = min(max((total[i] - floor) / (best - floor), 0), 1)
            n = len(got) or 1
            terms = [(0.35, sum(art[j] == art[i] for j in got) / n)]
            if got:
                terms.append((0.5, max(0.0, max(float(x[i] @ x[j]) for j in got))))
            if alb[i] is not None:
                terms.append((0.15, sum(alb[j] == alb[i] for j in got) / n))
            return lam * rel - (1 - lam) * sum(a * b for a, b in terms) / sum(a for a, _ in terms)

        left = [i for i in range(len(total)) if i not in got and total[i] >= floor]
        if not left:
            break
        got.append(min(left, key=lambda i: (-round(value(i), 12), -total[i], i)))
    assert A.select(rows, 10) == got


@pytest.mark.parametrize("seed", range(8))
def test_sequences_keep_artists_apart_when_they_can(seed):
    rows = some_pool(seed, 14)
    order = A.sequence(rows)
    assert sorted(order) == list(range(14))
    counts = rows.artist.value_counts()
    if counts.max() <= 7:
        assert A.neighbours(order, rows.artist.tolist()) == 0


def test_duration_fit_ends_in_tolerance_or_no_better():
    ms = [200_000, 210_000, None, 100_000, 300_000, 250_000]
    out = A.fit_duration([0, 1, 2], [3, 4, 5], ms, list(range(6)), 800_000, 10_000)
    assert all(ms[i] for i in out) and abs(sum(ms[i] for i in out) - 800_000) <= 10_000


def test_cover_and_stages():
    assert A.cover([{1}, {1, 2}, {3}, {2, 3}], {1, 2, 3}, 5) == [1, 2]
    rows = [[True, False], [False, True], [True, False], [False, True]]
    want = min(sum(not rows[i][s] for i, s in enumerate(c)) for c in itertools.combinations_with_replacement(range(2), 4))
    assert A.stage_violations(rows, 2) == want == 1


def test_beam_and_repair():
    x = np.eye(4)
    assert A.beam([[True, False], [False, True], [True, False], [False, True]], x, 2)[:2] == [0, 2]
    assert A.repair([{0, 1, 2}] * 3, [0, 1, 2], ["a", "a", "b"]) == [0, 2, 1]
    assert A.repair([{0, 1}] * 2, [0, 1], ["a", "a"]) is None


def test_kmeans_separates_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = np.eye(3)
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.05, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    c = L.spherical_kmeans(df, 3, state=f"{tmp_path}/state")
    got = {r.id: r.cluster for r in L.assign(df, c).collect()}
    assert len({(i % 3, k) for i, k in got.items()}) == 3
    assert np.allclose(L.spherical_kmeans(df, 3, rounds=40, state=f"{tmp_path}/state"), c, atol=1e-6)


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.uniform(0, 1, (12, 6)) * (rng.uniform(0, 1, (12, 6)) > 0.4)
    x = spark.createDataFrame([(f"a{i}", f"t{j}", float(m[i, j])) for i in range(12) for j in range(6) if m[i, j]], "artist string, term string, x double")
    terms, s, v = L.gram_svd(x, 3)
    assert terms == [f"t{j}" for j in range(6)] and np.allclose(s, np.linalg.svd(m)[1][:3])
    got = {r.artist: r.vector for r in L.project(x, L.truncated_svd(x, 3)[0]).collect()}
    assert all(np.allclose(got[f"a{i}"], m[i] @ v) for i in range(12))


def test_subspaces_find_the_same_svd(spark):
    rng = np.random.default_rng(5)
    m = rng.uniform(0, 1, (40, 14)) * (rng.uniform(0, 1, (40, 14)) > 0.5)
    x = spark.createDataFrame([(f"a{i}", f"t{j:02}", float(m[i, j])) for i in range(40) for j in range(14) if m[i, j]], "artist string, term string, x double")
    _, s, v = L.gram_svd(x, 3)
    table, values = L.subspace_svd(x, 3)
    got = {r.term: r.row for r in table.collect()}
    assert np.allclose(values, s, rtol=1e-6) and np.allclose(np.array([got[t] for t in sorted(got)]), v, atol=1e-4)


def test_near_durations_are_on_neighbouring_steps(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        a = rng.choice([rng.uniform(0, 2e5), rng.uniform(1e5, 1e7), 150_000.0])
        b = max(0.0, a + rng.uniform(-1.05, 1.05) * max(3000.0, 0.02 * a))
        rows.append((a, b))
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(3000.0), 0.02 * F.greatest("a", "b"))
    df = spark.createDataFrame(rows, "a double, b double").filter(near)
    assert df.count() > 2000 and df.filter(F.abs(I.duration_step(F.col("a")) - I.duration_step(F.col("b"))) > 1).count() == 0


def test_packed_vectors_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(50, 2, 100))
    (tmp_path / "vectors.i8").write_bytes(files.pack_vectors(rows.tolist()))
    got = files.read_packed(spark, f"{tmp_path}/vectors.i8").orderBy("row").collect()
    want = rows / np.linalg.norm(rows, axis=2, keepdims=True)
    assert len(got) == 50 and np.allclose([r.audio for r in got], want[:, 0], atol=0.5 / 127 + 1e-6)
    (tmp_path / "bad.i8").write_bytes(b"x" * 64)
    with pytest.raises(Exception, match="packed vector"):
        files.read_packed(spark, f"{tmp_path}/bad.i8").count()


def test_lines_reject_and_keep(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\nnot json\n{"id": 2, "name": "' + "y" * 100 + '"}\n')
    good, bad = files.read_lines(spark, f"{tmp_path}/a.jsonl", "id long, name string", 60)
    assert [r.id for r in good.collect()] == [1] and bad.count() == 2


def test_index_generation_ignores_order(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    a, b = files.write_index(df, f"{tmp_path}/x"), files.write_index(df.orderBy(F.desc("id")).repartition(5), f"{tmp_path}/y")
    files.publish(spark, f"{tmp_path}/x", a)
    assert a == b and files.current(spark, f"{tmp_path}/x").count() == 20
    with pytest.raises(ValueError):
        files.write_index(spark.createDataFrame([(1, [2.0, 0.0])], df.schema), f"{tmp_path}/z")


def test_playlist_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("T, \"q\"", ["A", "B"], "L", "X", 61_500)], "title string, artists array<string>, album string, isrc string, duration_ms long")
    files.write_playlist(df, f"{tmp_path}/csv")
    r = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert (r.title, r.artist, r.duration) == ('T, "q"', "A, B", "61")
    files.write_manifest(spark.createDataFrame([(1,), (2,)], "file_id long"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "file_id long, kind int, state string"), f"{tmp_path}/m")
    lines = sorted((json.loads(x.value) for x in spark.read.text(f"{tmp_path}/m").collect()), key=lambda x: x["file_id"])
    assert [j["kind"] for j in lines[0]["jobs"]] == [1, 2] and len(lines[1]["sha256"]) == 64
    assert files.safe_name("a/b: c") == "a_b_ c"


def test_catalog_is_written_with_search_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "Café del Mar", "Ångström", [3.0, 4.0])], "id long, title string, artist string, audio array<double>")
    files.write_catalog(df, f"{tmp_path}/c")
    r = spark.read.parquet(f"{tmp_path}/c").first()
    assert r.search == "angstrom cafe del mar" and r.audio == [0.6, 0.8] and r.audio_i8 == [76, 102]


def test_text_edges(spark):
    a, t = T.display_parts(F.col("x"))
    rows = spark.createDataFrame([("A - B - C",), ("Solo",), (" - x",), (None,)], "x string").select(a.alias("a"), t.alias("t")).collect()
    assert [tuple(r) for r in rows[:3]] == [("A", "B - C"), ("", "Solo"), ("", "x")]
    r = spark.createDataFrame([("Straße Über 東京!",)], "x string").select(T.latin_search(F.col("x")).alias("l"), T.unicode_search(F.col("x")).alias("u")).first()
    assert r.l == "stra e uber" and r.u == "straße uber 東京"


def test_stages_are_reserved():
    states = [[True, False], [True, True], [False, True], [True, True]]
    assert A.reserve([0.9, 0.8, 0.79, 0.7], states, 0.1, 0.15) == [0, 1]
    assert A.reserve([0.9, 0.6, 0.5], [[True, False], [False, False], [False, True]], 0.1, 0.15) == [0, None]
    assert A.reserve([0.9, 0.8], [[True, True], [True, True]], 0.1, 0.15, fixed=[[True, False]]) == [None, 0]
    assert A.reserve([], [], 0.1, 0.15) == []


def test_terms_inside_longer_ones(spark):
    terms = ["blue", "bluebird", "a", "jay", "bird's", "ü", ""]
    want = ["bird", "blue", "a", "zzz", "ü", ""]
    from melisma.operators import catalog as C

    got = C.terms_inside(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in want], "w string"), "w").collect()
    assert {tuple(r) for r in got} == {(t, w) for t in terms for w in want if w and w in t} and len(got) == len(set(got))


def test_exact_segment_scores(spark):
    from melisma.operators import evidence as E

    rows = [([(1, 3), (2, 4)],), ([(-1, 1), (-2, 2)],), ([],), ([(5, 0)],)]
    df = spark.createDataFrame(rows, "s array<struct<score:bigint,seconds:bigint>>")
    got = [tuple(r) for r in df.select(E.segment_millionths(F.col("s"), F.lit(False)), E.segment_millionths(F.col("s"), F.lit(True)), E.segment_millionths(F.col("s"), F.lit(False), True)).collect()]
    assert got == [(1_500_000, 2_000_000, 1_571_429), (-1_500_000, -1_000_000, -1_666_667), (None, None, None), (5_000_000, 5_000_000, None)]


def test_upsert_is_idempotent(spark, tmp_path):
    from melisma.streaming import feedback as S2

    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, v string, seq long")
    S2.upsert(a, f"{tmp_path}/t", ["id"], "seq")
    b = spark.createDataFrame([(1, "z", 2)], a.schema)
    S2.upsert(b, f"{tmp_path}/t", ["id"], "seq")
    S2.upsert(b, f"{tmp_path}/t", ["id"], "seq")
    assert sorted((r.id, r.v) for r in S2.current(spark, f"{tmp_path}/t").collect()) == [(1, "z"), (2, "y")]
    part = lambda v: {p.name for p in (tmp_path / "t" / "rows" / str(v)).glob("_part=*")}
    assert len(part(0)) == 2 and len(part(1)) == len(part(2)) == 1  # only the part of key 1 is written again
    S2.upsert(b.limit(0), f"{tmp_path}/t", ["id"], "seq")
    assert S2.current(spark, f"{tmp_path}/t").columns == ["id", "v", "seq"] and S2.current(spark, f"{tmp_path}/t").count() == 2


def test_stream_ignores_what_was_said_earlier(spark, tmp_path):
    from melisma.streaming import feedback as S2

    schema = "sequence long, listener long, track long, kind string, weight double"
    for k, rows in enumerate([[(5, 1, 1, "dislike", -1.0)], [(2, 1, 1, "like", 1.0), (3, 1, 1, "accept", 0.35)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = S2.preferences(src).writeStream.format("memory").queryName("prefs").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("prefs").collect()[-1]
    assert (last.direct_kind, last.review_kind) == ("dislike", "accept")


def test_separators_are_matched_as_far_as_they_go():
    assert A.separators([{0, 1}, {0}, {1, 2}], 3) == {0: 1, 1: 0, 2: 2} and len(A.separators([{0}, {0}], 1)) == 1


def test_noise_is_seeded():
    q = np.ones(8)
    assert (A.noisy(q, 0.1, 3) == A.noisy(q, 0.1, 3)).all() and (A.noisy(q, 0.1, 3) != A.noisy(q, 0.1, 4)).any() and (A.noisy(q, 0.0, 3) == q).all()


def test_reasons_follow_the_order():
    rows = some_pool(1, 6).assign(request=9)
    order = A.sequence(rows)
    r = A.reasons(rows, order)
    assert r["id"].tolist() == order and pd.isna(r["transition"][0]) and r["transition"].notna()[1:].all()


def test_sound_of_a_sine(spark):
    from melisma.functions import dsp

    t = np.arange(48_000) / 48_000
    rows = spark.createDataFrame([(1, (0.5 * np.sin(2 * np.pi * 1000 * t)).tolist(), 48_000), (2, [0.0] * 4096, 48_000), (3, [0.1], 48_000), (4, None, 48_000)], "id long, x array<double>, rate int")
    got = {r.id: r.f for r in rows.select("id", dsp.features(F.col("x"), F.col("rate")).alias("f")).collect()}
    assert abs(got[1].rms - 0.5 / 2**0.5) < 1e-3 and abs(got[1].crest - 2**0.5) < 1e-2 and got[1].mid > 0.99 and abs(got[1].centroid - 1000) < 20
    assert got[2].rms == 0 and got[2].centroid is None and got[3].rms is None and got[4].rms is None


def test_packs_combine(spark):
    rows = [(1, 1, "Song", "Band", 1, "", "i1", ""), (2, 2, "", "Band", 1, "m1", "i1", ""), (3, 1, "Song", "Band", 1, "", "", "")]
    df = spark.createDataFrame(rows, "id long, pack int, title string, artist string, duration_ms long, mbid string, isrc string, fingerprint string")
    got = sorted((r.root, r.title, r.mbid, r.n, r.assigned) for r in I.combined(df, "pack", ["title", "artist", "mbid", "isrc"]).collect())
    assert got == [(1, "Song", "m1", 2, "song band"), (3, "Song", None, 1, "song band-2")]


def test_automatic_playlists_hold_every_stage():
    for seed in range(6):
        rows = some_pool(seed)
        states = [[k % 3 == s for s in range(3)] for k in range(len(rows))]
        got = A.automatic(rows, states, 9)
        ranked = sorted(range(len(rows)), key=lambda i: (-rows.total[i], i))
        wanted = {i for i in A.reserve([rows.total[i] for i in ranked], [states[i] for i in ranked], 0.05, 0.15) if i is not None}
        assert len(got) == len(set(got)) == 9 and {ranked[i] for i in wanted} <= set(got)
    assert A.automatic(rows.iloc[:0], [], 9) == []


def test_requests_without_clauses_and_with_nulls(spark):
    from melisma.operators import requests as R

    requests = spark.createDataFrame([(1, "hybrid", "strict", 0, False, None), (2, "hybrid", "best_available", 0, True, ""), (3, "enhanced", "best_available", 60, True, "jazz"), (4, "hybrid", "strict", 0, False, None)], "request long, mode string, policy string, seconds long, temporal boolean, single_genre string")
    clauses = spark.createDataFrame([(4, "essential", "genre", None, None, None), (4, "preference", "genre", "dub", "positive", False), (4, "hard", "no_back_to_back_artist", "", None, False)], "request long, role string, kind string, value string, influence string, strict boolean")
    assert {tuple(r) for r in R.artist_diversity(requests, clauses).collect()} == {(1, False), (2, True), (3, False), (4, True)}
    got = {r.request: (r.supported, r.reasons) for r in R.walk_guard(requests, clauses).collect()}
    assert got == {1: (True, []), 2: (False, ["structure"]), 3: (False, ["duration"]), 4: (False, ["verification"])}
    assert R.artist_diversity(requests, clauses.limit(0)).count() == 4 and R.walk_guard(requests.limit(0), clauses).count() == 0


def test_proposals_are_checked(spark):
    from melisma.operators import requests as R

    code = "0a0b0c0d-0000-1111-2222-333344445555"
    q = spark.createDataFrame([(k, " A ", "T", "x" * (300 if k == 5 else 3)) for k in range(1, 7)] + [(7, None, "T", None)], "id long, artist string, title string, release string")
    r = spark.createDataFrame([(1, "A", "T", code.upper(), [code], "A", "T"), (2, "A", "T", "", None, None, None), (3, "A", "T", code, [], "A", "T"), (4, "B", "T", code, [code], "A", "T"), (6, "A", "T", code, [None], "A", "T")], "id long, artist_arg string, title_arg string, mbid string, artist_mbids array<string>, artist_name string, recording string")
    got = {x.id: (x.state, x.mbid) for x in R.mapping_proposals(q, r).collect()}
    assert got == {1: ("proposed", code), 2: ("none", None), 3: ("invalid_proposal", None), 4: ("mismatched", None), 5: ("invalid_query", None), 6: ("invalid_proposal", None), 7: ("invalid_query", None)}


def test_any_module_of_queries_can_be_the_first():
    """Python workers import the module of a function that they get before any other."""
    import subprocess
    import sys

    for m in ("vectors", "assembly", "requests", "registry"):
        code = f"import melisma.plans.{m}; from melisma.plans import registry; assert 'mmr_select' in registry.QUERIES"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_nearest_equals_all_pairs_with_ties_copies_and_missing_ids(spark, monkeypatch):
    """Blocks of any size give the best of all pairs: scores that are equal to nine places by id, ids that repeat, a query's own id left out however often it is there."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 4)), 5, axis=0) * rng.uniform(0.5, 2, size=(200, 1))
    x[7] = 0
    ids = rng.permutation(200).tolist()
    ids[3], ids[4], ids[5], ids[6] = ids[0], ids[0], None, None
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(900, [1.0])], "id long, vector array<double>").repartition(3)
    q = rows.filter("id % 9 = 0 and size(vector) = 4 and id <> 900")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for a, i in enumerate(ids):
        if i is not None and i % 9 == 0 and a != 7:
            want.setdefault(i, []).extend((-round(float(u[a] @ u[b]), 9), j) for b, j in enumerate(ids) if b != 7 and j not in (None, i))
    for k in (1, 6, 300):
        best = sorted((i, j, r + 1) for i, w in want.items() for r, (_, j) in enumerate(sorted(w)[:k]))
        for block, take in ((2_000_000, 8192), (30, 7), (1, 1)):
            if k == 6 or block > 1:
                monkeypatch.setattr(S, "BLOCK_NUMBERS", block)
                monkeypatch.setattr(S, "BLOCK_ROWS", take)
                assert sorted((r.query, r.id, r.rank) for r in S.nearest(rows, q, k).collect()) == best
    own = S.nearest(rows, q.filter("id <> 0"), 1, exclude_self=False).collect()
    assert own and all(abs(r.score - 1) < 1e-9 for r in own)


def test_nearest_holds_blocks_only(monkeypatch):
    """A task's memory is that of a block of similarities and of k rows a query, whatever numbers of queries and rows meet."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(4000, 8)), rng.normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vector"])
    names, q = np.arange(20_000, 24_000), q / np.linalg.norm(q, axis=1, keepdims=True)
    args = (names, q, 3, True) if hasattr(S, "BLOCK_NUMBERS") else (names.tolist(), q, 4)
    tracemalloc.start()
    found = sum(b.num_rows for b in S._best(iter([batch, batch]), *args))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000 * 3 and most < 150e6  # 320 MB would be all similarities of a batch
