"""Benchmark decontamination by a prefix-filtered join.

A benchmark window (10 consecutive words of an item; a shorter item is one window) is a set of 3-word shingles. All shingles of
the benchmark are counted over all documents; a window's shingles are ordered by rarity. A document that holds the window holds
all its shingles, so the necessary prefix is the one rarest shingle. Documents are joined on prefix shingles; the shingle's
place in the window fixes where the window would start, so words that lack room before or after drop out (length and positional
bounds), and the rest is compared word by word.

The benchmark is taken in blocks of at most BLOCK_BYTES of text (plus one item). One block's tables are sent to the executors;
a larger benchmark takes one pass over the documents a block, whose results are merged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import kernels as K
from .store import Scratch, column, tables, whole

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 8 << 20


@dataclass
class Items:
    """A block of the benchmark as arrays. Words are numbered from 1; 0 is any other word."""

    hashes: np.ndarray
    ids: np.ndarray
    words: list[bytes]
    windows: np.ndarray  # one row a distinct window, filled up with 0
    lengths: np.ndarray
    items: list[list[str]]  # of each window

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int) -> Items:
        texts = pa.array([t or "" for _, t in rows], pa.string())
        data, offsets = K.buffers(texts)
        s, e, _, upto = K.words(data, offsets)
        hashed = K.word_hashes(data, s, e)
        low = K.LOWER[data].tobytes()
        vocabulary: dict[bytes, int] = {}
        first: list[int] = []
        ids = np.zeros(len(s), np.int64)
        for i, (a, b) in enumerate(zip(s.tolist(), e.tolist(), strict=True)):
            w = low[a:b]
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary) + 1
                first.append(i)
            ids[i] = vocabulary[w]
        seen: dict[tuple[int, ...], set[str]] = {}
        for k, (name, _) in enumerate(rows):
            own = ids[upto[k] : upto[k + 1]].tolist()
            for at in range(max(1, len(own) - window + 1)) if own else ():
                seen.setdefault(tuple(own[at : at + window]), set()).add("" if name is None else str(name))
        matrix = np.zeros((len(seen), window), np.int64)
        for i, w in enumerate(seen):
            matrix[i, : len(w)] = w
        known = hashed[first] if first else np.zeros(0, np.uint64)
        order = np.argsort(known)
        return cls(known[order], order + 1, [b"", *vocabulary], matrix, (matrix > 0).sum(1), [sorted(x) for x in seen.values()])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0)

    def codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """One number for each k consecutive words, exact because the vocabulary of a block is below 2**21."""
        out = ids[: len(ids) - k + 1].copy()
        for j in range(1, k):
            out = out * (len(self.words)) + ids[j : len(ids) - k + 1 + j]
        return out

    def shingle_sizes(self, shingle: int) -> dict[int, np.ndarray]:
        """Windows by the size of their shingles: those with fewer words than a shingle are one shingle."""
        size = np.minimum(self.lengths, shingle)
        return {int(k): np.flatnonzero(size == k) for k in np.unique(size)}


def known_places(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places where k consecutive words of one row are all benchmark words."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    ok = rows[: len(ids) - k + 1] == rows[k - 1 :]
    for j in range(k):
        ok &= ids[j : len(ids) - k + 1 + j] > 0
    return np.flatnonzero(ok)


def rarity(items: Items, shingle: int) -> dict[int, np.ndarray]:
    return {k: np.unique(np.concatenate([items.codes(items.windows[w, : items.lengths[w]], k) for w in own])) for k, own in items.shingle_sizes(shingle).items()}


@K.tidy
def count_shingles(batches: Iterator[pa.RecordBatch], items: Items, wanted: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    counts = {k: np.zeros(len(c), np.int64) for k, c in wanted.items()}
    for batch in batches:
        data, offsets = K.buffers(batch.column(0))
        for a, b in K.blocks(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            s, e, rows, _ = K.words(own, at)
            ids = items.number(K.word_hashes(own, s, e))
            for k, codes in wanted.items():
                if len(places := known_places(ids, rows, k)):
                    got = items.codes(ids, k)[places]
                    i = np.minimum(np.searchsorted(codes, got), len(codes) - 1)
                    counts[k] += np.bincount(i[codes[i] == got], minlength=len(codes))
    for k, c in counts.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int64)), pa.array(c[some])], names=["k", "at", "n"])


@dataclass
class Prefixes:
    """Of one shingle size: the prefix shingles, and for each the windows that it stands for, with its place in them."""

    codes: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    places: np.ndarray


def prefixes(items: Items, wanted: dict[int, np.ndarray], counts: dict[int, np.ndarray], shingle: int) -> dict[int, Prefixes]:
    out = {}
    for k, own in items.shingle_sizes(shingle).items():
        chosen, places = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for i, w in enumerate(own):
            codes = items.codes(items.windows[w, : items.lengths[w]], k)
            n = counts[k][np.searchsorted(wanted[k], codes)]
            needed = len(codes)  # containment: all shingles are needed, so the prefix has len - needed + 1 = 1
            order = np.lexsort((codes, n))[: len(codes) - needed + 1]
            chosen[i], places[i] = codes[order[0]], order[0]
        by = np.argsort(chosen, kind="stable")
        codes, first = np.unique(chosen[by], return_index=True)
        out[k] = Prefixes(codes, np.append(first, len(by)), own[by], places[by])
    return out


def occurrences(items: Items, tables_: dict[int, Prefixes], own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In a block of texts: windows that occur, the word where each starts, the rows of words, and the words before each row."""
    s, e, rows, upto = K.words(own, at)
    ids = items.number(K.word_hashes(own, s, e))
    found_w, found_s = [], []
    for k, p in tables_.items():
        places = known_places(ids, rows, k)
        if not len(places) or not len(p.codes):
            continue
        got = items.codes(ids, k)[places]
        i = np.minimum(np.searchsorted(p.codes, got), len(p.codes) - 1)
        hit = p.codes[i] == got
        places, i = places[hit], i[hit]
        n = p.first[i + 1] - p.first[i]
        which = np.repeat(p.first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w, start = p.windows[which], np.repeat(places, n) - p.places[which]
        row = rows[np.repeat(places, n)]
        room = (start >= upto[row]) & (start + items.lengths[w] <= upto[row + 1])
        w, start = w[room], start[room]
        same = np.ones(len(w), bool)
        for j in range(items.windows.shape[1]):
            inside = items.lengths[w] > j
            same &= ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == items.windows[w, j])
        found_w.append(w[same])
        found_s.append(start[same])
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rows, upto
    w, start = np.concatenate(found_w), np.concatenate(found_s)
    # Equal numbers come from equal hashes; the words themselves decide.
    used = np.unique(np.concatenate([start + j for j in range(items.windows.shape[1])])) if len(start) else start
    used = used[used < len(ids)]
    low = K.LOWER[own].tobytes()
    wrong = [u for u in used.tolist() if ids[u] and low[s[u] : e[u]] != items.words[ids[u]]]
    if wrong:
        bad = np.zeros(len(ids) + 1, np.int64)
        bad[np.array(wrong) + 1] = 1
        bad = np.cumsum(bad)
        fine = bad[start + items.lengths[w]] == bad[start]
        w, start = w[fine], start[fine]
    return w, start, rows, upto


FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(ArrayType(IntegerType()))), StructField("items", ArrayType(StringType()))])


@K.tidy
def mark(batches: Iterator[pa.RecordBatch], items: Items, found: dict[int, Prefixes], text: int) -> Iterator[pa.RecordBatch]:
    """Of rows (row) or (row, n_words, spans, items), the latter an earlier block's results: the row with its number of words, its hit spans [from, to) in words, and its items."""
    for batch in batches:
        data, offsets = K.buffers(batch.column(0).field(text))
        before = batch.num_columns > 1
        n_words = np.zeros(batch.num_rows, np.int64)
        spans: list[list[list[int]]] = batch.column(2).to_pylist() if before else [[] for _ in range(batch.num_rows)]
        names: list[list[str]] = batch.column(3).to_pylist() if before else [[] for _ in range(batch.num_rows)]
        for a, b in K.blocks(offsets):
            w, start, rows, upto = occurrences(items, found, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n_words[a:b] = np.diff(upto)
            of = rows[start] if len(start) else start
            order = np.lexsort((start, of))
            w, start, of = w[order], start[order], of[order]
            for r, first in zip(*np.unique(of, return_index=True), strict=True):
                last = int(np.searchsorted(of, r, "right"))
                own, begin = w[first:last], (start[first:last] - upto[r]).tolist()
                merged = [tuple(x) for x in spans[a + r]] + list(zip(begin, (np.array(begin) + items.lengths[own]).tolist(), strict=True))
                spans[a + r] = union(merged)
                names[a + r] = sorted(set(names[a + r]).union(*(items.items[x] for x in np.unique(own))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))], names=["row", *FOUND.names])


def union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_contamination(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (a row of df, whole) and three columns: n_words, spans (disjoint word ranges inside benchmark windows) and items (sorted ids).

    Null and empty texts have no words. Items that are null, empty or without words have no windows; repeated items count once by
    their id. An empty benchmark or table gives rows without hits, or no rows.
    """
    spark = df.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = total // block_bytes + 1
    texts, at = df.select(column(text_col)), df.columns.index(text_col)
    out, scratch = whole(df), Scratch(spark, "decontam")
    schema = StructType([*out.schema.fields, *FOUND.fields])
    for b in range(n_blocks):
        # Items without an id, or with the same, part by their texts.
        block = Items.of([tuple(r) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b).select("id", "text").collect()], window)
        wanted = rarity(block, shingle)
        sent = spark.sparkContext.broadcast((block, wanted))
        counts = {k: np.zeros(len(c), np.int64) for k, c in wanted.items()}
        for k, place, n in texts.mapInArrow(lambda x, sent=sent: count_shingles(x, *sent.value), "k int, at long, n long").groupBy("k", "at").agg(F.sum("n")).collect():
            counts[k][place] = n
        found = spark.sparkContext.broadcast(prefixes(block, wanted, counts, shingle))
        if b:
            out = scratch.write(out, f"block{b}")
        out = out.mapInArrow(lambda x, sent=sent, found=found: mark(x, sent.value[0], found.value, at), schema)
    return out


def op2_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x[1] - x[0]).cast("long"))
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )
