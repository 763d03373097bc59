"""Anchored journeys, walks, budgets and discovery, against plain versions."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from melisma.operators import discovery as D
from melisma.operators import journeys as J


def tracks(artists, anchors=(), seed=0):
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(artists)
    return pd.DataFrame({"id": range(n), "total": rng.random(n).round(3), "artist": list(artists), "vector": list(rng.normal(size=(n, 4))), "title": [str(k) for k in range(n)], "anchor": [anchors.index(i) if i in anchors else None for i in range(n)]})


def far_enough(order, artist, gap):
    return all(artist[a] != artist[b] for p, a in enumerate(order) for b in order[p + 1 : p + 1 + gap])


def possible(artist, fixed, count, gap):
    """By trying every order."""
    free = [i for i in range(len(artist)) if i not in fixed.values()]
    places = [p for p in range(count) if p not in fixed]
    for some in itertools.permutations(free, len(places)):
        order = [None] * count
        for p, i in [*fixed.items(), *zip(places, some, strict=True)]:
            order[p] = i
        if far_enough(order, artist, gap):
            return True
    return False


@pytest.mark.parametrize("seed", range(40))
def test_no_stricter_journey_exists(seed):
    rng = random.Random(seed)
    artists = [rng.choice("abc") for _ in range(rng.randint(2, 7))]
    anchors = rng.sample(range(len(artists)), rng.randint(0, min(3, len(artists))))
    count, hard = rng.randint(max(1, len(anchors)), len(artists)), rng.randint(0, 1)
    f = J.journey(tracks(artists, anchors, seed), count, hard)
    n, kept = len(f.order), [i for i in anchors if i in f.order]
    assert kept == anchors[: len(kept)] and len(set(f.order)) == n and far_enough(f.order, artists, f.gap)
    fixed = dict(zip(J.places(len(kept), n), kept, strict=True)) if kept else {}
    assert all(f.order[p] == i for p, i in fixed.items())
    if f.gap < J.GAP:
        assert not possible(artists, fixed, n, f.gap + 1) and f"soft_spacing:{f.gap}" in f.notices
    if "anchor_spacing" not in f.notices:
        for more in range(n + 1, count + 1):
            assert not possible(artists, dict(zip(J.places(len(kept), more), kept, strict=True)) if kept else {}, more, hard)
    assert (n < count) == any(x.startswith("hard_spacing") for x in f.notices) or "anchor_spacing" in f.notices


def test_anchors_stand_at_their_places_in_the_order_of_waypoints():
    f = J.journey(tracks("abcdefg", [5, 2, 6]), 7)
    assert [f.order[k] for k in (0, 3, 6)] == [5, 2, 6] and f.gap == J.GAP and not f.notices


def test_hard_spacing_leaves_tracks_out_and_soft_spacing_says_so():
    assert J.journey(tracks("aa"), 2, hard=1).notices == ["soft_spacing:1", "hard_spacing:1"] or J.journey(tracks("aa"), 2, hard=1).notices[-1] == "hard_spacing:1"
    soft = J.journey(tracks("aa"), 2)
    assert len(soft.order) == 2 and soft.gap == 0 and soft.notices == ["soft_spacing:0"]


def test_scarce_separators_go_between_tracks_of_one_artist():
    # Only track 3 may stand between the two anchors of artist a.
    f = J.journey(tracks("aaxyaa", [0, 1]), 3, hard=1, wished=1)
    assert f.order[0] == 0 and f.order[2] == 1 and f.order[1] in (2, 3) and f.gap == 1
    rows = tracks(["a", "b", "a", "b", "a", "b", "c"], [0, 2, 4])
    rows["total"] = [1, 1, 1, 1, 1, 1, 0.0]
    f = J.journey(rows, 5, hard=1, wished=1)
    assert far_enough(f.order, rows["artist"].tolist(), 1) and len(f.order) == 5


def test_a_search_that_is_ended_is_reported():
    rows = tracks(["a"] * 6 + ["b"] * 5 + ["c"] * 5)
    assert "search_limit" in J.journey(rows, 16, wished=2, smoothness=0.9, hard=0).notices or J.fill(rows, {}, 16, 2, limit=3)[1]


def test_empty_requests_and_missing_vectors():
    assert J.journey(tracks(""), 3).order == []
    rows = tracks("abc")
    rows["vector"] = [None, None, None]
    assert sorted(J.journey(rows, 3).order) == [0, 1, 2]


def test_walks_pass_their_waypoints_and_widen_their_window():
    rows = tracks("abcdef", seed=3)
    x = np.array([v / np.linalg.norm(v) for v in rows["vector"]])
    out = J.walked(rows, x[[1, 4]], 6, window=1)
    assert out[0] == 1 and len(out) == 6 and len(set(out)) == 6
    assert J.walked(rows, x[[1, 4]], 6, 0.3, 7) == J.walked(rows, x[[1, 4]], 6, 0.3, 7)
    assert J.walked(tracks("aab"), x[[0, 1]][:, :4], 3, window=1)[0] in (0, 1, 2)
    same = tracks("aaaa")
    assert len(J.walked(same, x[[0, 1]], 4, window=1)) == 1  # nothing else may follow, however wide the window


def test_budgets_are_filled_in_turns(spark):
    rng = random.Random(4)
    plan = [("one", 3), ("two", 2), ("three", 4)]
    rows = {name: sorted({(r, rng.randint(0, 25)) for r in range(6) for _ in range(rng.choice([0, 1, 9]))}) for name, _ in plan}
    scored = {name: [(r, i, round(rng.random(), 1)) for r, i in x] for name, x in rows.items()}
    frames = [(name, spark.createDataFrame(scored[name], "request int, id int, score double"), b) for name, b in plan]
    got = {}
    for r in D.budgeted(frames).collect():
        got.setdefault(r.request, []).append((r.channel, r.turn, r.id, r.spilled))
        assert {(p.channel, p.score) for p in r.provenance} == {(n, s) for n, x in scored.items() for q, i, s in x if (q, i) == (r.request, r.id)}
    for request in range(6):
        ranked = {n: {i: k for k, (_, i) in enumerate(sorted((-s, i) for q, i, s in scored[n] if q == request))} for n, _ in plan}
        own = {n: [] for n, _ in plan}
        for i in {i for x in ranked.values() for i in x}:
            own[min((x[i], k) for k, (n, _) in enumerate(plan) for x in [ranked[n]] if i in x)[1] == 0 and plan[0][0] or plan[min((ranked[n][i], k) for k, (n, _) in enumerate(plan) if i in ranked[n])[1]][0]].append(i)
        for n in own:
            own[n].sort(key=lambda i, n=n: (ranked[n][i], i))
        want = [(n, k + 1, i, False) for n, b in plan for k, i in enumerate(own[n][:b])]
        turns = [(n, b + t + 1, own[n][b + t], True) for t in range(30) for n, b in plan if b + t < len(own[n])]
        assert sorted(got.get(request, [])) == sorted(want + turns[: 9 - len(want)])
    assert D.invalid_provenance(D.budgeted(frames), frames).count() == 0
    assert D.invalid_provenance(D.budgeted(frames), frames[1:]).count() > 0


@pytest.mark.parametrize("batch,growth,most", [(1, 1, None), (3, 2, None), (100, 2, None), (2, 1, 5)])
def test_discovery_equals_one_wide_pool(spark, batch, growth, most):
    rng = random.Random(batch)
    first = [(r, i, k) for r in range(5) for k, i in enumerate(rng.sample(range(20), rng.randint(1, 9)))]
    second = [(r, i, k) for r in range(6) for k, i in enumerate(rng.sample(range(30), 6))]
    good = {(r, i) for r in range(6) for i in range(30) if rng.random() < (0.0 if r == 3 else 0.5)}
    allowed = spark.createDataFrame(sorted(good), "request int, id int")
    frame = lambda x: spark.createDataFrame(x, "request int, id int, rank int")
    accepted, attempted, outcomes = D.discover([frame(first), frame(second)], lambda c: c.join(allowed, ["request", "id"]), 3, batch, growth, most)
    out = {r.request: r for r in outcomes.collect()}
    tried, got = {}, {}
    for r in attempted.collect():
        assert (r.request, r.id) not in tried
        tried[r.request, r.id] = r.turn
    for r in accepted.collect():
        got.setdefault(r.request, {})[r.position] = r.id
    for r in range(6):
        line = list(dict.fromkeys([i for q, i, _ in first if q == r] + [i for q, i, _ in second if q == r]))[: most or 99]
        want = [i for i in line if (r, i) in good][:3]
        assert [got.get(r, {})[k] for k in sorted(got.get(r, {}))] == want
        mine = sorted(i for q, i in tried if q == r)
        assert out[r].attempts == len(mine) and set(mine) == set(line[: len(mine)]) and out[r].accepted == len(want)
        assert out[r].outcome == ("fulfilled" if len(want) == 3 else "limited" if most and len(line) == most else "partial")
        if batch == 1 and len(want) == 3:
            assert mine == sorted(line[: line.index(want[-1]) + 1])  # nothing is tried once there is enough
