"""Best-fit packing of tokenised documents, by partitions first and then up a tree.

Each task tokenises its documents, cuts those over the limit, and packs what it has best-fit decreasing. Bins that are nearly full
are final. Underfull bins become items of the next round, which has a fraction of the tasks; no task holds more than about ROUND_ITEMS of them. When
there is one task left, or tasks of that size hardly free a bin, the root of the tree packs all bins that are left: for
best fit only the number of bins of each size matters, so the plan is made of these counts (at most `limit` numbers), and bins take
their places in it by their ranks among bins of their size. Token ids stay with their pieces: nearly full bins are written once, only underfull ones move.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

from . import kernels as K
from .store import Scratch, column, tables

LIMIT, NEARLY_FULL, ROUND_ITEMS, LEAST_GAIN = 2048, 0.985, 8000, 0.1
#: Bytes of token ids that a task holds before it packs them.
HELD_BYTES = 1 << 24
#: Numbers of bins that the root makes begin here, beyond those of the rounds.
ROOT = 16 << 58


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """Little-endian unsigned 32-bit ids of texts, equal to those of the tokenizer file's own library at its defaults.

    The file is a byte-level BPE whose ids are its merge order, so tiktoken, which is several times as fast, gives the same ids from
    the same vocabulary. Texts beyond Latin letters, where the two libraries' character classes might differ, and texts that spell a special token go to the file's own library.
    """

    # Fixed value: the pattern of byte-level BPE pre-tokenisation.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        # Byte-level files spell a printable Latin-1 byte as itself, and the n-th other byte as the character 256 + n.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        spelt = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary = content["model"]["vocab"]
        ranks = {bytes(spelt[c] for c in token): i for token, i in vocabulary.items() if all(c in spelt for c in token) and not re.fullmatch(r"<\|.*\|>", token)}
        self.fast = tiktoken.Encoding("packing", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in content.get("added_tokens", ())]
        self.other = re.compile("[^\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027\u20ac]")

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if self.other.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def pieces(ids: bytes, limit: int) -> list[tuple[int, int]]:
    """(start, length); only what exceeds the limit is cut, and then the first piece is the odd one."""
    n = len(ids) // 4
    cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Best-fit decreasing: every item, largest first, goes into the open bin with the least room that holds it. Bit r of `rooms` is set if a bin has room r."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - size:
            open_[left].append(b)
            rooms |= 1 << left
    return bins


MEMBER = ["doc_id", "piece", "start", "length", "ids"]


def bin_schema(id_type: DataType) -> StructType:
    kinds = [id_type, IntegerType(), LongType(), LongType(), BinaryType()]
    return StructType([StructField("bin", LongType()), StructField("size", IntegerType()), StructField("members", ArrayType(StructType([StructField(n, t) for n, t in zip(MEMBER, kinds, strict=True)])))])


def packed(sizes: np.ndarray, first: np.ndarray, members: pa.StructArray, limit: int, number: int) -> Iterator[pa.RecordBatch]:
    """Bins of items, of which item i has the members first[i] to first[i + 1], in batches."""
    got = best_fit(sizes.tolist(), limit)
    for a in range(0, len(got), 250):
        part = got[a : a + 250]
        order = np.array([i for b in part for i in b], np.int64)
        n = first[order + 1] - first[order]
        which = np.repeat(first[order], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.cumsum(n)[np.cumsum([len(b) for b in part]) - 1]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), members.take(pa.array(which)))
        size = np.add.reduceat(sizes[order], np.cumsum([0, *(len(b) for b in part[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(number + a, number + a + len(part))), pa.array(size, pa.int32()), lists], names=["bin", "size", "members"])


@K.tidy
def tokenise_and_pack(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    tokenizer, number = Tokenizer(path), TaskContext.get().partitionId() << 40
    rows: list[tuple] = []
    size, kind = 0, pa.int64()

    def bins() -> Iterator[pa.RecordBatch]:
        if rows:
            lengths = np.array([r[3] for r in rows], np.int64)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield from packed(lengths, np.arange(len(rows) + 1), pa.StructArray.from_arrays(columns, names=MEMBER), limit, number)

    for batch in batches:
        kind = batch.column(0).type
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = tokenizer(text.as_py() or "") + b"\0\0\0\0"
            rows += [(doc, k, start, length, ids[4 * start : 4 * (start + length)]) for k, (start, length) in enumerate(pieces(ids, limit))]
            size += len(ids)
            if len(rows) >= 4 * ROUND_ITEMS or size > HELD_BYTES:
                yield from bins()
                number += len(rows)
                rows, size = [], 0
    yield from bins()


@K.tidy
def repack(batches: Iterator[pa.RecordBatch], limit: int, level: int) -> Iterator[pa.RecordBatch]:
    """One round of a task: its underfull bins are the items. A task has about ROUND_ITEMS of them."""
    if not (some := list(batches)):
        return
    t = pa.Table.from_batches(some).combine_chunks()
    if t.num_rows:
        lists = t["members"].chunk(0)
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        yield from packed(t["size"].to_numpy().astype(np.int64), first, lists.flatten(), limit, level << 58 | TaskContext.get().partitionId() << 38)


def root_plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of so many bins of each size, as runs: (size, first rank, rank behind the last, how many a sequence, first sequence, offset of the first one in it).

    Sequences with the same room left are one group, so each size adds a few groups, however many bins there are.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    sequences = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            fits = min((r for r in rooms if r >= size), default=None)
            if fits is None:
                each = limit // size
                n = max(1, left // each)
                room, at, there = limit, sequences, n
                sequences += n
            else:
                at, there = rooms[fits].pop()
                if not rooms[fits]:
                    del rooms[fits]
                room, each = fits, fits // size
                n = min(there, max(1, left // each))
            each = min(each, left)
            if n < there:
                rooms.setdefault(room, []).append((at + n, there - n))
            out.append((size, rank, rank + n * each, each, at, limit - room))
            rank, left = rank + n * each, left - n * each
            if room - each * size:
                rooms.setdefault(room - each * size, []).append((at, n))
    return out


def packed_at_the_root(bins: DataFrame, limit: int) -> DataFrame:
    """(bin, members, base): all bins that are left, packed as one. Ranks among bins of a size come from counts by size and segment, of which there are as many as bins in one."""
    spark = bins.sparkSession
    sizes = {r[0]: r[1] for r in bins.groupBy("size").count().collect()}  # at most `limit` numbers
    plan = spark.createDataFrame(root_plan(sizes, limit) or [(0, 0, 0, 1, 0, 0)], "size int, lo long, hi long, each int, at long, before long")
    segments = math.isqrt(sum(sizes.values())) + 1
    light = bins.select("bin", "size", F.pmod(F.xxhash64("bin"), F.lit(segments)).alias("segment"))
    starts = light.groupBy("size", "segment").agg(F.count(F.lit(1)).alias("there"))
    starts = starts.select("size", "segment", (F.sum("there").over(Window.partitionBy("size").orderBy("segment")) - F.col("there")).alias("start"))
    ranked = light.withColumn("r", F.row_number().over(Window.partitionBy("size", "segment").orderBy("bin")) - 1).join(starts, ["size", "segment"]).select("bin", "size", (F.col("start") + F.col("r")).alias("rank"))
    # A few runs a size, some thousands at most.
    placed = ranked.join(F.broadcast(plan), "size").filter("rank >= lo and rank < hi")
    nth = F.col("rank") - F.col("lo")
    placed = placed.select(F.col("bin").alias("b"), (F.lit(ROOT) + F.col("at") + F.floor(nth / F.col("each"))).cast("long").alias("sequence"), (F.col("before") + nth % F.col("each") * F.col("size")).alias("base"))
    return bins.join(placed, F.col("bin") == F.col("b")).select(F.col("sequence").alias("bin"), "members", "base")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset. A sequence is its pieces' ids by offset.

    A null or empty text is the single id 0. Repeated rows are packed each. Ids of documents are of any type. An empty table gives no rows. Other columns play no part.
    After the root has packed, no two of the bins that were not nearly full would fit into one sequence, so these are more than half full on average.
    """
    path = tokenizer or default_tokenizer()
    scratch = Scratch(df.sparkSession, "packing")
    docs = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    schema = bin_schema(docs.schema["doc_id"].dataType)
    bins = scratch.write(docs.mapInArrow(lambda x: tokenise_and_pack(x, path, limit), schema), "level0")
    enough = int(limit * NEARLY_FULL)
    under, out = F.col("size") < enough, []
    level, n = 0, bins.filter(under).count()
    while True:
        out.append(bins.filter(~under).select("bin", "members", F.lit(0).cast("long").alias("base")))
        if n <= ROUND_ITEMS:
            break
        level += 1
        bins = scratch.write(bins.filter(under).repartition(-(-n // ROUND_ITEMS), "bin").mapInArrow(lambda x, level=level: repack(x, limit, level), schema), f"level{level}")
        before, n = n, bins.filter(under).count()
        if n > (1 - LEAST_GAIN) * before:
            out.append(bins.filter(~under).select("bin", "members", F.lit(0).cast("long").alias("base")))
            break
    out.append(packed_at_the_root(bins.filter(under), limit))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    before = F.aggregate(F.transform(F.slice("members", 1, F.col("at")), lambda m: m["length"]), F.col("base"), lambda a, n: a + n)
    return every.select("bin", "members", "base", F.posexplode("members").alias("at", "m")).select("m.doc_id", "m.piece", "m.start", "m.length", F.col("bin").alias("sequence_id"), before.alias("offset"), "m.ids")


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
