"""Playlist assembly: selection, sequencing, duration. Each step depends on the picks before it, so a request is one group; its candidates are capped (512) before they come here, and Spark works on many requests at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP, MOST_TRACKS = 512, 100
FLOOR, WINDOW, LAMBDA_MIN = 0.05, 0.80, 0.55
REDUNDANCY, ARTIST, ALBUM = 0.50, 0.35, 0.15
RELEVANCE, POSITION = 0.15, 0.35


def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which of them are available."""
    d = max((len(v) for v in vectors if v is not None), default=1)
    x = np.array([v if v is not None and len(v) == d else np.zeros(d) for v in vectors], float).reshape(len(vectors), d)
    n = np.linalg.norm(x, axis=1)
    return np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0), n > 0


def select(rows: pd.DataFrame, count: int, diversity: float = 0.5) -> list[int]:
    """Maximal marginal relevance. Columns: id, total, artist, album (may be null), vector (may be null). Candidates under the floor are out; a term of the penalty that a candidate lacks is left out of its mean; ties go by total, then id."""
    total = rows["total"].to_numpy(float)
    if not len(total) or count <= 0:
        return []
    best = total.max()
    floor = max(FLOOR, best - WINDOW)
    left = list(np.flatnonzero(total >= floor))
    relevance = np.ones(len(total)) if best <= floor else np.clip((total - floor) / (best - floor), 0, 1)
    lam = 1 - (1 - LAMBDA_MIN) * min(max(diversity, 0.0), 1.0)
    x, there = unit(rows["vector"])
    ids, artist, album = rows["id"].tolist(), rows["artist"].tolist(), rows["album"].tolist()
    nearest, seen = np.zeros(len(total)), False
    picked: list[int] = []
    uses: dict[object, int] = {}
    albums: dict[object, int] = {}
    while left and len(picked) < count:
        def score(i: int) -> float:
            n = len(picked)
            terms = [(ARTIST, uses.get(artist[i], 0) / n if n else 0.0)]
            if there[i] and seen:
                terms.append((REDUNDANCY, nearest[i]))
            if album[i] is not None:
                terms.append((ALBUM, albums.get(album[i], 0) / n if n else 0.0))
            return lam * relevance[i] - (1 - lam) * sum(w * v for w, v in terms) / sum(w for w, _ in terms)

        k = min(left, key=lambda i: (-round(score(i), 12), -round(total[i], 12), ids[i]))
        picked.append(k)
        left.remove(k)
        uses[artist[k]] = uses.get(artist[k], 0) + 1
        albums[album[k]] = albums.get(album[k], 0) + 1
        if there[k]:
            nearest, seen = np.maximum(nearest, x @ x[k]), True
    return picked


def excess(counts: dict, remaining: int) -> int:
    """How far the artist with the most tracks is from fitting without standing next to itself."""
    return max((2 * c - remaining for c in counts.values()), default=0)


def sequence(rows: pd.DataFrame, smoothness: float = 0.5, diversity: float = 0.5, target: np.ndarray | None = None) -> list[int]:
    """Greedy order: of what keeps a later order without neighbours of one artist possible, and has no artist of the last steps, the best by relevance, likeness to the track before, and to the path's point."""
    x, there = unit(rows["vector"])
    total, ids, artist = rows["total"].to_numpy(float), rows["id"].tolist(), rows["artist"].tolist()
    gap = max(1, round(3 * diversity))
    left, out = list(range(len(ids))), []
    while left:
        counts: dict[object, int] = {}
        for i in left:
            counts[artist[i]] = counts.get(artist[i], 0) + 1
        apart = [i for i in left if not out or artist[i] != artist[out[-1]]] or left

        def after(i: int) -> int:
            return excess({a: c - (a == artist[i]) for a, c in counts.items()}, len(left) - 1)

        least = min(map(after, apart))
        pool = [i for i in apart if after(i) == least]
        pool = [i for i in pool if artist[i] not in [artist[j] for j in out[-gap:]]] or pool
        position = len(out) / max(1, len(ids) - 1)

        def score(i: int) -> float:
            s = RELEVANCE * total[i]
            if out and there[i] and there[out[-1]]:
                s += smoothness * float(x[i] @ x[out[-1]])
            if target is not None and there[i]:
                s += POSITION * float(x[i] @ waypoint(target, position))
            return s

        k = min(pool, key=lambda i: (-round(score(i), 12), ids[i]))
        out.append(k)
        left.remove(k)
    return improve(out, x, artist, smoothness)


def waypoint(path: np.ndarray, position: float) -> np.ndarray:
    """The point at position 0 to 1 of a path through unit vectors, of length 1 again."""
    at = position * (len(path) - 1)
    k = min(int(at), max(len(path) - 2, 0))
    v = path[k] if len(path) == 1 else (1 - (at - k)) * path[k] + (at - k) * path[k + 1]
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def neighbours(order: list[int], artist: list) -> int:
    return sum(artist[a] == artist[b] for a, b in zip(order, order[1:], strict=False))


def improve(order: list[int], x: np.ndarray, artist: list, smoothness: float, passes: int = 3, window: int = 4) -> list[int]:
    """Swaps within a window that raise the sum of likenesses and put no more artists side by side."""
    out = list(order)
    value = lambda o: smoothness * sum(float(x[a] @ x[b]) for a, b in zip(o, o[1:], strict=False))
    now, close = value(out), neighbours(out, artist)
    for _ in range(passes):
        changed = False
        for i in range(len(out)):
            for j in range(i + 1, min(i + window, len(out))):
                out[i], out[j] = out[j], out[i]
                v, c = value(out), neighbours(out, artist)
                if c <= close and v > now + 1e-9:
                    now, close, changed = v, c, True
                else:
                    out[i], out[j] = out[j], out[i]
        if not changed:
            break
    return out


def fit_duration(selected: list[int], pool: list[int], ms: list[int | None], recording: list, target: int, tolerance: int, fixed: int = 0) -> list[int]:
    """Adds, removes or swaps one track at a time while (tracks of unknown length, distance to the target beyond the tolerance) falls."""
    out = list(selected)

    def objective(o: list[int]) -> tuple[int, int]:
        known = [ms[i] for i in o if ms[i]]
        return len(o) - len(known), max(0, abs(fixed + sum(known) - target) - tolerance)

    for _ in range(2 * MOST_TRACKS):
        best, choice = objective(out), None
        if best == (0, 0):
            break
        used = {recording[i] for i in out}
        fresh = [j for j in pool if ms[j] and j not in out and recording[j] not in used]
        tries = [out[:i] + out[i + 1 :] for i in range(len(out) - 1, -1, -1) if len(out) > 1]
        tries += [out[:i] + [j] + out[i + 1 :] for i in range(len(out) - 1, -1, -1) for j in fresh]
        tries += [[*out, j] for j in fresh if len(out) < MOST_TRACKS]
        for o in tries:
            if (v := objective(o)) < best:
                best, choice = v, o
        if choice is None:
            break
        out = choice
    return out


def cover(groups: list[set], wanted: set, limit: int) -> list[int]:
    """Greedy set cover: the candidate that adds most, the earlier one of equals."""
    out: list[int] = []
    left = set(wanted)
    while left and len(out) < limit:
        k = max(range(len(groups)), key=lambda i: (len(groups[i] & left), -i), default=None)
        if k is None or not groups[k] & left:
            break
        out.append(k)
        left -= groups[k]
    return out


def reserve(totals: list[float], states: list[list[bool]], least: float, window: float, fixed: list[list[bool]] = ()) -> list[int | None]:
    """For each stage the first of the ranked candidates that is eligible for it, not yet reserved, and relevant: at least `least`, and within `window` of the best. None for a stage that a fixed track already serves (each serves one), or without such a candidate."""
    floor = max(least, (totals[0] if totals else 0.0) - window)
    stages = len(states[0]) if states else len(fixed[0]) if fixed else 0
    serving: set[int] = set()
    out: list[int | None] = []
    for s in range(stages):
        if (f := next((i for i, row in enumerate(fixed) if i not in serving and row[s]), None)) is not None:
            serving.add(f)
            out.append(None)
            continue
        out.append(next((i for i, row in enumerate(states) if row[s] and i not in out and totals[i] >= floor), None))
    return out


def automatic(rows: pd.DataFrame, states: list[list[bool]], count: int, diversity: float = 0.5, smoothness: float = 0.5, window: float = 0.15) -> list[int]:
    """A playlist from ranked candidates: one reserved for each stage that has a relevant one, the others selected, and all sequenced. Columns as for select."""
    ranked = sorted(range(len(rows)), key=lambda i: (-round(rows["total"].iloc[i], 12), rows["id"].iloc[i]))
    held = reserve([rows["total"].iloc[i] for i in ranked], [states[i] for i in ranked], FLOOR, window) if ranked else []
    held = [ranked[i] for i in held if i is not None][:count]
    kept = held + [i for i in select(rows, count, diversity) if i not in held][: count - len(held)]
    return [kept[i] for i in sequence(rows.iloc[kept].reset_index(drop=True), smoothness, diversity)] if kept else []


def stage_violations(states: list[list[bool]], stages: int) -> int:
    """The fewest tracks out of order for a journey through stages: each track is put into a stage, stages never go back, and a track that doesn't match its stage counts."""
    best = [0] * stages
    for row in states:
        low, nxt = None, []
        for s in range(stages):
            low = best[s] if low is None else min(low, best[s])
            nxt.append(low + (not row[s]))
        best = nxt
    return min(best, default=0)


def beam(states: list[list[bool]], x: np.ndarray, stages: int, width: int = 32) -> list[int]:
    """An order of all tracks through stages: partial orders are kept by violations, then by likeness of neighbours."""
    n = len(states)
    need = [s for s in range(stages) for _ in range(n // stages + (s < n % stages))]
    beams: list[tuple[int, float, tuple[int, ...]]] = [(0, 0.0, ())]
    for s in need:
        grown = []
        for bad, like, o in beams:
            for i in range(n):
                if i not in o:
                    grown.append((bad + (not states[i][s]), like + (float(x[i] @ x[o[-1]]) if o else 0.0), (*o, i)))
        grown.sort(key=lambda g: (g[0], -round(g[1], 12), g[2]))
        beams = grown[:width]
    return list(beams[0][2])


def repair(allowed: list[set], order: list[int], artist: list, limit: int = 20_000) -> list[int] | None:
    """Backtracking over at most `limit` states: every place gets a track that may stand there, and no artist follows itself."""
    n, tried, out = len(allowed), 0, []

    def go() -> bool:
        nonlocal tried
        if len(out) == n:
            return True
        for i in order:
            if i in out or i not in allowed[len(out)] or (out and artist[out[-1]] == artist[i]):
                continue
            tried += 1
            if tried > limit:
                return False
            out.append(i)
            if go():
                return True
            out.pop()
        return False

    return list(out) if go() else None


def walk(rows: pd.DataFrame, seed: np.ndarray, count: int, lookback: int = 3) -> list[int]:
    """The plain walk: the nearest unused track to the sum of the last picks, no artist twice in a row, no recording twice."""
    x, there = unit(rows["vector"])
    artist, title, ids = rows["artist"].tolist(), rows["title"].tolist(), rows["id"].tolist()
    history, out, used = [seed], [], set()
    while len(out) < count:
        q = np.sum(history[-lookback:], axis=0)
        ok = [i for i in range(len(ids)) if there[i] and i not in out and (artist[i], title[i]) not in used and (not out or artist[out[-1]] != artist[i])]
        if not ok:
            break
        k = min(ok, key=lambda i: (-round(float(x[i] @ q), 12), ids[i]))
        out.append(k)
        used.add((artist[k], title[k]))
        history.append(x[k])
    return out


def capped(candidates: DataFrame, cap: int = CAP) -> DataFrame:
    """At most `cap` candidates a request, by total, then id: the limit of the request's own pool."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("total"), "id"))).filter(F.col("_n") <= cap).drop("_n")


def per_request(candidates: DataFrame, choose, columns: str = "request long, position long, id long") -> DataFrame:
    """Runs choose(rows) -> row numbers in order on each request's candidates, in id order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        order = choose(rows)
        return pd.DataFrame({"request": rows["request"].iloc[0], "position": range(1, len(order) + 1), "id": [rows["id"][i] for i in order]})

    return capped(candidates).groupBy("request").applyInPandas(run, columns)


def noisy(query: np.ndarray, noise: float, seed: int) -> np.ndarray:
    """A query with Gaussian noise of a part of its own length; one seed gives one result."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return query + rng.normal(size=len(query)) * noise * np.linalg.norm(query) / np.sqrt(len(query))


def separators(gaps: list[set], tracks: int) -> dict[int, int]:
    """Scarce tracks to the gaps that need one between tracks of one artist: gap -> track, as many as can be (augmenting paths). gaps[i] holds the tracks that may stand there."""
    of: dict[int, int] = {}

    def place(gap: int, seen: set[int]) -> bool:
        for t in sorted(gaps[gap]):
            if t < tracks and t not in seen:
                seen.add(t)
                if t not in of or place(of[t], seen):
                    of[t] = gap
                    return True
        return False

    for g in range(len(gaps)):
        place(g, set())
    return {g: t for t, g in of.items()}


def reasons(rows: pd.DataFrame, order: list[int]) -> pd.DataFrame:
    """Why each track stands where it does: its relevance, its likeness to the one before (null for the first or without vectors), and the distance to its artist's last track (null if there is none)."""
    x, there = unit(rows["vector"])
    out, last = [], {}
    for k, i in enumerate(order):
        j = order[k - 1] if k else None
        like = float(x[i] @ x[j]) if j is not None and there[i] and there[j] else None
        artist = rows["artist"].iloc[i]
        out.append((rows["request"].iloc[0], k + 1, int(rows["id"].iloc[i]), float(rows["total"].iloc[i]), like, k - last[artist] if artist in last else None))
        last[artist] = k
    return pd.DataFrame(out, columns=["request", "position", "id", "relevance", "transition", "artist_gap"]).astype({"artist_gap": "Int64", "transition": "Float64"})


def playlists(candidates: DataFrame, count: int, diversity: float = 0.5, smoothness: float = 0.5) -> DataFrame:
    """From candidates (request, id, total, artist, album, vector) to playlists with their reasons: selection, then sequence, a group a request."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        kept = rows.iloc[select(rows, count, diversity)].reset_index(drop=True)
        return reasons(kept, sequence(kept, smoothness, diversity) if len(kept) else [])

    return capped(candidates).groupBy("request").applyInPandas(run, "request long, position long, id long, relevance double, transition double, artist_gap long")
