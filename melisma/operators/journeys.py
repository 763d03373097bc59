"""Journeys with fixed anchors: an order of tracks in which anchors stand at their places and no artist comes too close to itself.

A request is one bounded group (see assembly). The search fills the places between anchors one after the other, best candidate first, and goes back
where it can't go on; a matching of the places beside anchors with the tracks that may stand there tells early that it can't. What can't be kept is
given up in order, and every step down is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .assembly import POSITION, RELEVANCE, capped, noisy, separators, unit, waypoint

#: Tracks that a search of one level may put down, and the artist gap that is wished for.
STATES, GAP = 20_000, 3


@dataclass
class Found:
    order: list[int]
    gap: int
    notices: list[str]


def places(anchors: int, count: int) -> list[int]:
    """Where anchors stand: the first at the start, the last at the end, the others evenly between."""
    return [0] if anchors == 1 else [round(k * (count - 1) / (anchors - 1)) for k in range(anchors)]


def fill(rows: pd.DataFrame, fixed: dict[int, int], count: int, gap: int, path: np.ndarray | None = None, smoothness: float = 0.5, limit: int = STATES) -> tuple[list[int] | None, bool]:
    """(order, whether the search was ended by the limit): `count` tracks, those in `fixed` (place -> row) where they belong, and any two of one artist more than `gap` places apart. None if there is no such order or none was found within `limit` states."""
    x, there = unit(rows["vector"])
    total, ids, artist = rows["total"].to_numpy(float), rows["id"].tolist(), rows["artist"].tolist()
    taken = set(fixed.values())
    free = [i for i in range(len(ids)) if i not in taken]
    open_ = [p for p in range(count) if p not in fixed]
    if len(open_) > len(free) or any(artist[a] == artist[b] and abs(p - q) <= gap for p, a in fixed.items() for q, b in fixed.items() if p < q):
        return None, False
    near = {p: {artist[fixed[q]] for q in fixed if abs(q - p) <= gap} for p in open_}
    out: list[int | None] = [fixed.get(p) for p in range(count)]
    used: set[int] = set()
    tried, ended = 0, False

    def possible(k: int) -> bool:
        """Whether each open place from the k-th on beside an anchor can have a track of its own."""
        tight = [p for p in open_[k:] if near[p]]
        index = {i: n for n, i in enumerate(free)}
        gaps = [{index[i] for i in free if i not in used and artist[i] not in near[p]} for p in tight]
        return len(separators(gaps, len(free))) == len(tight)

    def choices(p: int) -> list[int]:
        around = {artist[out[q]] for q in range(max(0, p - gap), min(count, p + gap + 1)) if out[q] is not None}
        before = out[p - 1] if p else None
        score = RELEVANCE * total
        if before is not None and there[before]:
            score = score + smoothness * (x @ x[before])
        if path is not None:
            score = score + POSITION * (x @ waypoint(path, p / max(1, count - 1)))
        return sorted((i for i in free if i not in used and artist[i] not in around), key=lambda i: (-round(float(score[i]), 12), ids[i]))

    # Depth first without recursion: one iterator of choices a place.
    if not possible(0):
        return None, False
    stack = [iter(choices(open_[0]))] if open_ else []
    while stack:
        p = open_[len(stack) - 1]
        if out[p] is not None:
            used.discard(out[p])
            out[p] = None
        i = next(stack[-1], None)
        if i is None:
            stack.pop()
            continue
        tried += 1
        if tried > limit:
            ended = True
            break
        out[p] = i
        used.add(i)
        if not possible(len(stack)):
            continue
        if len(stack) == len(open_):
            return list(out), False
        stack.append(iter(choices(open_[len(stack)])))
    return (list(out), False) if not open_ else (None, ended)


def journey(rows: pd.DataFrame, count: int, hard: int = 0, wished: int = GAP, smoothness: float = 0.5, limit: int = STATES) -> Found:
    """The order that gives up least. Columns: id, total, artist, vector (may be null), anchor (the number of its waypoint; null for other tracks).

    First the wished gap is made smaller, step by step, down to `hard` (0: artists may follow themselves). If not even that leaves an order, there are fewer tracks: fixed ones stay as long as they can.
    notices: `soft_spacing` with the gap that was kept, `hard_spacing` with the tracks that were left, `anchor_spacing` if anchors themselves are closer than `hard` allows (the latest of them go), `search_limit` if a search was ended.
    """
    anchor = rows["anchor"]
    anchors = sorted((i for i in range(len(rows)) if not pd.isna(anchor.iloc[i])), key=lambda i: (anchor.iloc[i], rows["id"].iloc[i]))[:count]
    x, there = unit(rows["vector"])
    notices: list[str] = []
    want = min(count, len(rows))
    while True:
        path = x[[i for i in anchors if there[i]]] if any(there[i] for i in anchors) else None
        for n in range(want, max(len(anchors), 1) - 1, -1):
            fixed = dict(zip(places(len(anchors), n), anchors, strict=True)) if anchors else {}
            for gap in range(max(wished, hard), hard - 1, -1):
                order, ended = fill(rows, fixed, n, gap, path, smoothness, limit)
                if ended and "search_limit" not in notices:
                    notices.append("search_limit")
                if order is not None:
                    if gap < wished:
                        notices.append(f"soft_spacing:{gap}")
                    if n < want:
                        notices.append(f"hard_spacing:{n}")
                    return Found(order, gap, notices)
        if not anchors:
            return Found([], hard, notices)
        anchors = anchors[:-1]
        if "anchor_spacing" not in notices:
            notices.append("anchor_spacing")


def walked(rows: pd.DataFrame, path: np.ndarray, count: int, noise: float = 0.0, seed: int = 0, window: int = 10) -> list[int]:
    """The plain walk from waypoint to waypoint: at each step the track nearest to the path's point there, shifted by noise that the seed decides.

    Only the `window` nearest are looked at; where none of these may follow (used, same recording, same artist as the one before) the window doubles, until it holds all tracks. The walk ends where nothing may follow.
    """
    x, there = unit(rows["vector"])
    artist, title, ids = rows["artist"].tolist(), rows["title"].tolist(), rows["id"].tolist()
    out: list[int] = []
    recordings: set[tuple] = set()
    every = [i for i in range(len(ids)) if there[i]]
    for step in range(count):
        q = noisy(waypoint(path, step / max(1, count - 1)), noise, seed * 1000 + step) if noise else waypoint(path, step / max(1, count - 1))
        near = sorted(every, key=lambda i: (-round(float(x[i] @ q), 12), ids[i]))
        size, k = window, None
        while k is None:
            k = next((i for i in near[:size] if i not in out and (artist[i], title[i]) not in recordings and (not out or artist[out[-1]] != artist[i])), None)
            if k is None and size >= len(near):
                return out
            size *= 2
        out.append(k)
        recordings.add((artist[k], title[k]))
    return out


def journeys(candidates: DataFrame, count: int, hard: int = 0, wished: int = GAP) -> DataFrame:
    """request, position, id, gap and notices for candidates (request, id, total, artist, vector, anchor); a request without an order has no rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        f = journey(rows, count, hard, wished)
        return pd.DataFrame({"request": rows["request"].iloc[0], "position": range(1, len(f.order) + 1), "id": [rows["id"][i] for i in f.order], "gap": f.gap, "notices": [f.notices] * len(f.order)})

    return capped(candidates).groupBy("request").applyInPandas(run, "request long, position long, id long, gap int, notices array<string>")
