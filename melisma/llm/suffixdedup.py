"""Exact removal of repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller id. Sorting all suffixes of the corpus would move every byte many
times, so suffixes are sorted only where it can matter:

1. Every LENGTH-byte string selects one anchor, the place of its least GRAM-byte hash. A maximal run of strings with one anchor is a piece. Equal strings
   have equal anchors, and so lie in pieces of one anchor hash; pieces are dealt by that hash (only hashes are moved).
2. Pieces that are equal as a whole need no sort: all but those in the least document are covered.
3. Where one anchor hash has different pieces of different documents, these pieces' bytes are fetched, once for each distinct piece, and their
   suffixes are sorted: by eight bytes first, then by mergesort whose comparisons find the common extension by binary search over prefix
   polynomial hashes. Neighbours that share LENGTH bytes are one class; equal hashes are verified byte by byte.
4. Coverage goes back to the documents, which compute their pieces again and drop the covered bytes.

Pieces are known by 40 bits of their anchor's hash (48 or 64 for a corpus over 2 or 500 TB, so that unrelated pieces rarely share one) and 64 of their own. A piece in many documents is reduced to its least document in every ROUND_BYTES of
text before the shuffle, so a passage in a third of all documents arrives once for these. Blobs of many entries are moved, not rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import kernels as K
from .store import Scratch, column, tables

LENGTH = 50
INDEX_BITS = 24
SEGMENT = 1 << 23
#: Pieces in a bucket of step 1, bytes of text in a bucket of step 4; and the most buckets that there are.
BUCKET_PIECES, BUCKET_BYTES, MOST_BUCKETS = 1 << 18, 1 << 25, 1 << 20
#: Bytes of text to a task of each shuffle, and the most tasks; beyond that a task has more, and sorts on disk.
TASK_BYTES, MOST_TASKS = 16 << 20, 50_000
#: Bytes of text whose repeats are settled among each other before the shuffle.
ROUND_BYTES = 1 << 23
#: Different pieces of one anchor from which on it is hot.
HOT = 256
WHOLE = np.iinfo(np.int32).max
NO_ID = -(1 << 63)
FULL, ASK, TEXT = 0, 1, 2


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: each piece's row, start and end byte, anchor hash and own hash."""
    n = len(data)
    if n > SEGMENT and len(offsets) == 2:  # a text of this size is a block of its own
        parts = []
        for lo in range(0, n - length + 1, SEGMENT):
            part = data[lo : min(n, lo + SEGMENT + length - 1)]
            row, s, e, anchor, own = _pieces(part, np.array([0, len(part)]), length)
            parts.append((row, s + lo, e + lo, anchor, own))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _pieces(data, offsets, length)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gram = length // 2 + 1
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    values = K.BYTE_VALUES[data]
    h = K.prefix(values, K.BASES[0])
    grams = K.mix((h[gram:] - h[:-gram]) * K.powers(K.BASES[0], len(data))[1][: len(data) - gram + 1])
    key = grams >> np.uint64(INDEX_BITS) << np.uint64(INDEX_BITS)
    key |= np.arange(len(key), dtype=np.uint64)
    least = K.sliding_min(key, width)  # of each string: anchor hash, then the leftmost place
    inside = np.zeros(len(data) + 1, np.int32)
    fits = offsets[1:] - offsets[:-1] >= length
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    chosen = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    s = at[first]
    e = at[np.append(first[1:], len(at)) - 1] + length
    row = np.searchsorted(offsets, s, "right") - 1
    h = K.prefix(values, K.BASES[1])
    own = K.mix((h[e] - h[s]) * K.powers(K.BASES[1], len(data))[1][s] + (e - s).astype(np.uint64))
    return row, s, e, grams[(chosen[first] & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)], own


def ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def home(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document."""
    return (K.mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def anchor_kinds(total: int) -> tuple[str, str]:
    """The types that an anchor's hash is written in, for a corpus of so many bytes: leading bits first."""
    return "u4", "u1" if total <= 2 << 40 else "u2" if total <= 500 << 40 else "u4"


def shortened(anchor: np.ndarray, kinds: tuple[str, str]) -> np.ndarray:
    return anchor >> np.uint64(64 - 8 * sum(np.dtype(k).itemsize for k in kinds))


def halves(anchor: np.ndarray, kinds: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """A shortened hash in no more bytes than it needs."""
    return anchor.astype(kinds[0]), (anchor >> np.uint64(32)).astype(kinds[1])


def blobs(to: np.ndarray, kind: int, *columns: np.ndarray, steps: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """Entries by where they go: (to, kind, the columns one after another). With `steps` the first column, which is sorted, is written as differences, most of which are 0 and compress to nothing."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
    edges = [0, *cuts.tolist(), len(to)] if len(to) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        parts = [c[a:b] for c in columns]
        if steps:
            parts[0] = np.diff(parts[0], prepend=0)
        yield int(to[a]), kind, b"".join(np.ascontiguousarray(c).tobytes() for c in parts)


def entries(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def as_batches(rows: Iterator[tuple[int, int, bytes]], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 24
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["to", "kind", "blob"])


BLOBS = "to long, kind int, blob binary"


def anchor_bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(anchor) % np.uint64(n)).astype(np.int64)


@K.tidy
def find_pieces(batches: Iterator[pa.RecordBatch], n_buckets: int, n_homes: int, length: int, kinds: tuple[str, str] = ("u4", "u1")) -> Iterator[pa.RecordBatch]:
    """Step 1, with each round's repeats settled: entries (document, anchor, piece) by anchor, and, passed on by document, what a smaller document of the round covers."""

    def of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        doc = ids(batch.column(0))
        data, offsets = K.buffers(batch.column(1))
        for lo, hi in K.blocks(offsets, ROUND_BYTES):
            yield from round_of(doc[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def round_of(doc: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        got = []
        for a, b in K.blocks(offsets):
            row, _, _, anchor, own = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
            got.append((doc[a:b][row], shortened(anchor, kinds), own))
        if not got:
            return
        d, anchor, own = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((d, own))
        d, anchor, own = d[order], anchor[order], own[order]
        if not len(d):
            return
        new = np.ones(len(d), bool)
        new[1:] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])
        again = np.zeros(len(d), bool)
        again[1:] = ~new[1:] & (d[1:] == d[:-1])
        over = ~new & ~again
        yield from blobs(home(d[over], n_homes) % n_buckets, FULL, d[over], own[over])
        order = np.argsort(d[new], kind="stable")
        d, anchor, own = d[new][order], anchor[new][order], own[new][order]
        yield from blobs(anchor_bucket(anchor, n_buckets), ASK, d, *halves(anchor, kinds), own, steps=True)

    for batch in batches:
        yield from as_batches(of(batch))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Of blob rows sorted by bucket: each bucket's blobs."""
    now, held = None, []
    for batch in batches:
        for to, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if to != now:
                if held:
                    yield now, held
                now, held = to, []
            held.append((kind, blob))
    if held:
        yield now, held


@K.tidy
def settle_pieces(batches: Iterator[pa.RecordBatch], n_homes: int, kinds: tuple[str, str] = ("u4", "u1")) -> Iterator[pa.RecordBatch]:
    """Steps 2 and 3, first half: what equal pieces cover, and which pieces' bytes are needed; both by document."""

    def of(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        for kind, blob in held:
            if kind == FULL:
                d, own = entries(blob, "i8", "u8")
                yield from blobs(home(d, n_homes), FULL, d, own, np.zeros(len(d), np.int32), np.full(len(d), WHOLE, np.int32))
        asked = [entries(blob, "i8", *kinds, "u8") for kind, blob in held if kind == ASK]
        if not asked:
            return
        d = np.concatenate([np.cumsum(x[0]) for x in asked])
        anchor = np.concatenate([x[1] | x[2].astype(np.uint64) << np.uint64(32) for x in asked])
        own = np.concatenate([x[3] for x in asked])
        del asked
        order = np.lexsort((d, own, anchor))
        d, anchor, own = d[order], anchor[order], own[order]
        group = np.ones(len(d), bool)
        group[1:] = anchor[1:] != anchor[:-1]
        new = group.copy()
        new[1:] |= own[1:] != own[:-1]
        leader = d[new][np.cumsum(new) - 1]
        over = np.flatnonzero(d > leader)
        if len(over):
            once = np.ones(len(over), bool)
            once[1:] = (d[over][1:] != d[over][:-1]) | (own[over][1:] != own[over][:-1])
            over = over[once]
            yield from blobs(home(d[over], n_homes), FULL, d[over], own[over], np.zeros(len(over), np.int32), np.full(len(over), WHOLE, np.int32))
        # Distinct pieces of one anchor, if their least documents differ.
        d, anchor, own = d[new], anchor[new], own[new]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(first, len(d)))
        mixed = np.repeat(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first), size)
        yield from blobs(home(d[mixed], n_homes), ASK, d[mixed], own[mixed], np.repeat(size > HOT, size)[mixed].astype(np.uint8))

    for _, held in by_bucket(batches):
        yield from as_batches(of(held))


class Replies:
    """What came back for a bucket of documents, looked up by (document, piece)."""

    def __init__(self, d: np.ndarray, own: np.ndarray, *rest: np.ndarray) -> None:
        key = self.key(d, own)
        order = np.argsort(key, kind="stable")
        self.keys, self.d, self.own, self.rest = key[order], d[order], own[order], [r[order] for r in rest]
        self.docs = np.unique(d)

    def has(self, d: np.ndarray) -> np.ndarray:
        """Whether there is any reply for a document."""
        if not len(self.docs):
            return np.zeros(len(d), bool)
        return self.docs[np.minimum(np.searchsorted(self.docs, d), len(self.docs) - 1)] == d

    @staticmethod
    def key(d: np.ndarray, own: np.ndarray) -> np.ndarray:
        return K.mix(own ^ K.mix(d.astype(np.uint64)))

    def find(self, d: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (which of the asked, which reply)."""
        key = self.key(d, own)
        a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        n = b - a
        asked = np.repeat(np.arange(len(d)), n)
        reply = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = (self.d[reply] == d[asked]) & (self.own[reply] == own[asked])
        return asked[same], reply[same]


def with_texts(batches: Iterator[pa.RecordBatch], kind: int, *kinds: str) -> Iterator[tuple[pa.RecordBatch, Replies]]:
    """Of rows (to, kind, blob, ...) sorted by bucket and kind: batches of texts of one bucket, and the bucket's replies of a kind."""
    now, held, replies = None, [], None
    for batch in batches:
        to, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((to[1:] != to[:-1]) | ((what[1:] == TEXT) != (what[:-1] == TEXT))) + 1
        edges = [0, *cuts.tolist(), len(to)] if len(to) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            if to[a] != now:
                now, held, replies = to[a], [], None
            if what[a] != TEXT:
                held += [x for x, k in zip(batch.column(2).slice(a, b - a).to_pylist(), what[a:b], strict=True) if k == kind]
                continue
            if replies is None:
                found = [entries(x, *kinds) for x in held] or [[np.zeros(0, k) for k in kinds]]
                replies = Replies(*(np.concatenate(x) for x in zip(*found, strict=True)))
                held, found = [], []
            yield batch.slice(a, b - a), replies


@K.tidy
def fetch(batches: Iterator[pa.RecordBatch], n_buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Step 3: the bytes of pieces that are asked for, by anchor.

    Pieces of a hot anchor (where a common passage begins or ends, say) are taken apart into their strings, which go by their own hashes; of equal strings
    only the least document's goes, the others are settled here and passed on without bytes.
    """
    for batch, replies in with_texts(batches, ASK, "i8", "u8", "u1"):
        doc = ids(batch.column(3))
        if not (mine := replies.has(doc)).any():
            continue
        keep = np.flatnonzero(mine)
        doc, texts = doc[keep], batch.column(4).take(pa.array(keep))
        data, offsets = K.buffers(texts)
        strings: list[tuple[np.ndarray, ...]] = []
        for a, b in K.blocks(offsets):
            block = data[offsets[a] : offsets[b]]
            row, s, e, anchor, own = pieces(block, offsets[a : b + 1] - offsets[a], length)
            d = doc[a:b][row]
            asked, reply = replies.find(d, own)
            if not len(asked):
                continue
            once = np.unique(Replies.key(d[asked], own[asked]), return_index=True)[1]  # a piece that a document repeats
            asked, hot = asked[once], replies.rest[0][reply[once]] > 0
            raw = block.tobytes()
            cool, warm = asked[~hot], asked[hot]
            if len(cool):
                yield _fetched(anchor_bucket(anchor[cool], n_buckets), d[cool], own[cool], np.zeros(len(cool), np.int64), [raw[x:y] for x, y in zip(s[cool].tolist(), e[cool].tolist(), strict=True)])
            if len(warm):
                n = e[warm] - s[warm] - length + 1
                which = np.repeat(warm, n)
                rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = s[which] + rel
                h = K.prefix(K.BYTE_VALUES[block], K.BASES[3])
                name = K.mix((h[at + length] - h[at]) * K.powers(K.BASES[3], len(block))[1][at])
                text = np.array([raw[x : x + length] for x in at.tolist()], f"V{length}")
                strings.append((name, d[which], own[which], rel, text))
        if strings:
            name, d, own, rel, text = (np.concatenate(x) for x in zip(*strings, strict=True))
            order = np.lexsort((d, name))
            name, d, own, rel, text = name[order], d[order], own[order], rel[order], text[order]
            new = np.append(True, name[1:] != name[:-1])
            leader = np.flatnonzero(new)[np.cumsum(new) - 1]
            sent = (d == d[leader]) | (text != text[leader])
            yield _fetched((name[sent] % np.uint64(n_buckets)).astype(np.int64), d[sent], own[sent], rel[sent], [x.tobytes() for x in text[sent]])
            yield _fetched(home(d[~sent], n_buckets), d[~sent], own[~sent], rel[~sent], [None] * int((~sent).sum()))


FETCHED = "to long, doc long, own long, at long, bytes binary"


def _fetched(to: np.ndarray, d: np.ndarray, own: np.ndarray, at: np.ndarray, raw: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to), pa.array(d), pa.array(own.astype(np.int64)), pa.array(at), pa.array(raw, pa.binary())], names=["to", "doc", "own", "at", "bytes"])


class Text:
    """Bytes with prefix hashes."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.data = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
        self.h = K.prefix(K.BYTE_VALUES[self.data], K.BASES[2])
        self.p = K.powers(K.BASES[2], len(self.data))[0]

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether n bytes from i and from j have equal hashes: differences of prefix sums, brought to a common power."""
        return (self.h[i + n] - self.h[i]) * self.p[j] == (self.h[j + n] - self.h[j]) * self.p[i]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes suffixes i and j have in common, up to depth, by binary search."""
        out = np.zeros(len(i), np.int64)
        step = 1 << (self.depth.bit_length() - 1)
        while step:
            longer = out + step
            ok = longer <= self.depth
            ok[ok] = self.same(i[ok] + out[ok], j[ok] + out[ok], step)
            out[ok] += step
            step >>= 1
        return out

    def less(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i before j, i equal to j) in the first depth bytes."""
        n = self.extension(i, j)
        return (n < self.depth) & (self.data[i + n] < self.data[j + n]), n >= self.depth


def suffix_order(text: Text, starts: np.ndarray) -> np.ndarray:
    """The suffixes in order of their first depth bytes: by eight bytes, then by mergesort of those that agree in these. All runs of a level are merged at once: an element's place is its own rank plus its rank in the other run."""
    eight = np.zeros(len(starts), np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | text.data[starts + k].astype(np.uint64)
    order = np.argsort(eight, kind="stable")
    out, eight = starts[order], eight[order]
    first = np.flatnonzero(np.append(True, eight[1:] != eight[:-1])) if len(out) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(out)))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    width = 1
    while len(size) and width < size.max():
        at = np.flatnonzero(end - begin > width)
        rank = at - begin[at]
        pair = begin[at] + rank // (2 * width) * (2 * width)
        left = (rank // width) % 2 == 0
        middle = np.minimum(pair + width, end[at])
        stop = np.minimum(pair + 2 * width, end[at])
        lo, hi = np.where(left, middle, pair), np.where(left, stop, middle)
        base = lo.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            m = (lo[open_] + hi[open_]) // 2
            before, equal = text.less(out[m], out[at[open_]])
            goes = before | (equal & ~left[open_])  # equal ones of the left run come first
            lo[open_] = np.where(goes, m + 1, lo[open_])
            hi[open_] = np.where(goes, hi[open_], m)
        place = pair + np.where(left, at - pair, at - middle) + (lo - base)
        merged = out.copy()
        merged[place] = out[at]
        out = merged
        width *= 2
    return out


def classes(text: Text, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the number of each one's class of equal first depth bytes. Neighbours with equal hashes are compared byte by byte; should that ever fail, bytes alone decide."""
    order = suffix_order(text, starts)
    equal = text.same(order[1:], order[:-1], text.depth)
    at = np.flatnonzero(equal) + 1
    for a in range(0, len(at), 1 << 18):
        i = at[a : a + (1 << 18)]
        reach = np.arange(text.depth)
        if (text.data[order[i][:, None] + reach] != text.data[order[i - 1][:, None] + reach]).any():
            strings = np.ascontiguousarray(text.data[order[:, None] + np.arange(text.depth)]).view(f"V{text.depth}").ravel()
            _, number = np.unique(strings, return_inverse=True)
            by = np.argsort(number, kind="stable")
            return order[by], number[by]
    return order, np.cumsum(np.append(0, ~equal)) if len(order) else np.zeros(0, np.int64)


@K.tidy
def sort_suffixes(batches: Iterator[pa.RecordBatch], n_homes: int, length: int) -> Iterator[pa.RecordBatch]:
    """Step 3: of each bucket's pieces, the strings that a smaller document has too, as byte ranges of the piece, by document."""

    def of(t: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        known = t.filter(pc.is_null(t["bytes"]))
        if known.num_rows:
            d, own, at = known["doc"].to_numpy(), known["own"].to_numpy().astype(np.uint64), known["at"].to_numpy()
            yield from blobs(home(d, n_homes), FULL, d, own, at.astype(np.int32), (at + length).astype(np.int32))
            t = t.filter(pc.is_valid(t["bytes"]))
        if not t.num_rows:
            return
        data, offsets = K.buffers(t["bytes"])
        d, own, at = t["doc"].to_numpy(), t["own"].to_numpy().astype(np.uint64), t["at"].to_numpy()
        n = np.diff(offsets) - length + 1
        starts = np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order, number = classes(Text(data, length), starts)
        p = np.searchsorted(offsets, order, "right") - 1  # each start's piece
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        least = np.repeat(np.minimum.reduceat(d[p], first), np.diff(np.append(first, len(order))))
        hit = np.sort(order[d[p] > least])
        if not len(hit):
            return
        p = np.searchsorted(offsets, hit, "right") - 1
        new = np.append(True, (hit[1:] != hit[:-1] + 1) | (p[1:] != p[:-1]))
        a, b = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] + length
        p = p[new]
        yield from blobs(home(d[p], n_homes), FULL, d[p], own[p], (a - offsets[p] + at[p]).astype(np.int32), (b - offsets[p] + at[p]).astype(np.int32))

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        to = t["to"].to_numpy()
        edges = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield from as_batches(of(t.slice(a, b - a).combine_chunks()))
        rest = t.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield from as_batches(of(rest.combine_chunks()))


@K.tidy
def apply(batches: Iterator[pa.RecordBatch], length: int, as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """Step 4. Columns from the fourth on: id, text, and the row's other columns as one struct."""
    for batch, replies in with_texts(batches, FULL, "i8", "u8", "i4", "i4"):
        doc = ids(batch.column(3))
        data, offsets = K.buffers(batch.column(4))
        for lo, hi in K.blocks(offsets, ROUND_BYTES // 2):
            removed, spans, kept = [], [], []
            for a, b in ((lo + a, lo + b) for a, b in K.blocks(offsets[lo : hi + 1])):
                block, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                gone = covered(doc[a:b], block, at, replies, length)
                upto = np.concatenate([[0], np.cumsum(gone)])
                removed.append(upto[at[1:]] - upto[at[:-1]])
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                inner = at[:-1][at[:-1] < len(block)]
                start[inner] = gone[inner]
                upto = np.concatenate([[0], np.cumsum(start)])
                spans.append(upto[at[1:]] - upto[at[:-1]])
                left = block[~gone].tobytes()
                ends = np.cumsum(np.diff(at) - removed[-1]).tolist()
                kept += [left[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            rest = [batch.column(i).slice(lo, hi - lo) for i in range(3, batch.num_columns)]
            if as_text:
                null = batch.column(4).slice(lo, hi - lo).is_null().to_pylist()
                result = pa.array([None if no else x.decode("utf-8", "ignore") for x, no in zip(kept, null, strict=True)], pa.string())
            else:
                result = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.diff(offsets[lo : hi + 1])), pa.array(np.concatenate(removed)), pa.array(np.concatenate(spans)), result],
                names=[*batch.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept"],
            )


def covered(doc: np.ndarray, block: np.ndarray, at: np.ndarray, replies: Replies, length: int) -> np.ndarray:
    """Which bytes of a block of texts go."""
    if not replies.has(doc).any():
        return np.zeros(len(block), bool)
    row, s, e, _, own = pieces(block, at, length)
    asked, reply = replies.find(doc[row], own)
    level = np.zeros(len(block) + 1, np.int32)
    np.add.at(level, s[asked] + replies.rest[0][reply], 1)
    np.add.at(level, np.minimum(e[asked], s[asked] + np.minimum(replies.rest[1][reply].astype(np.int64), e[asked] - s[asked])), -1)
    return np.cumsum(level)[:-1] > 0


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stages whose results are written. The scheduler holds on to the last job until there is another, so a job of one row goes first."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """row (a row of df without its text), text, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes). As text, kept is a string (null for null), in which what is left of a cut character is missing.

    Null texts are empty; texts under `length` bytes lose nothing. Ids are integers, or anything that casts to long without loss; an id that doesn't is an error. Only smaller ids count: rows that repeat an
    id don't cover each other (they meet in one bucket), and a null id is less than all others. An empty table gives no rows. Other columns pass through, whatever they are called.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffixdedup")
    doc, text = column(id_col).cast("long").alias("doc"), column(text_col).alias("text")
    total = df.agg(F.coalesce(F.sum(F.octet_length(column(text_col))), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, total // TASK_BYTES))
    kinds = anchor_kinds(total)
    n_buckets = int(min(MOST_BUCKETS, max(64, total // 13 // BUCKET_PIECES)))
    n_homes = int(min(MOST_BUCKETS, max(64, total // BUCKET_BYTES)))
    texts = df.select(doc, text)
    dealt = texts.mapInArrow(lambda x: find_pieces(x, n_buckets, n_homes, length, kinds), BLOBS).repartition(tasks, "to").sortWithinPartitions("to")
    replies = scratch.write(dealt.mapInArrow(lambda x: settle_pieces(x, n_homes, kinds), BLOBS), "replies")
    free(spark)

    # A document's bucket is computed in numpy, where that of its replies is.
    home_of = F.arrow_udf(lambda d: pa.array(home(ids(d), n_homes)), LongType())

    def with_replies(rows: DataFrame, names: list[str], kind: int, *more: DataFrame) -> DataFrame:
        back = replies.filter(F.col("kind") == kind)
        for m in more:
            back = back.unionByName(m)
        types = dict(zip(rows.columns, (f.dataType for f in rows.schema.fields), strict=True))
        back = back.select("to", "kind", "blob", *(F.lit(None).cast(types[c]).alias(c) for c in names))
        own = rows.select(home_of("doc").alias("to"), F.lit(TEXT).alias("kind"), F.lit(None).cast(BinaryType()).alias("blob"), *names)
        return back.unionByName(own).repartition(tasks, "to").sortWithinPartitions("to", "kind")

    asked = with_replies(texts, ["doc", "text"], ASK).mapInArrow(lambda x: fetch(x, n_buckets, length), FETCHED)
    partial = scratch.write(asked.repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(lambda x: sort_suffixes(x, n_homes, length), BLOBS), "partial")
    free(spark)
    rows = df.select(doc, text, F.struct(*(column(c) for c in df.columns if c != text_col)).alias("row"))
    out = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if as_text else BinaryType())])
    done = with_replies(rows, ["doc", "text", "row"], FULL, partial).mapInArrow(lambda x: apply(x, length, as_text), out)
    return done.select("row", "text", "n_bytes", "n_removed", "n_spans", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
