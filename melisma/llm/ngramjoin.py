"""Jaccard self-join of word n-gram sets by chosen paths.

Texts are sets of 5-word shingles. Sets are embedded by T minhashes, so that all have T tokens (coordinate, minimum), and two sets share
a token with a chance of their Jaccard similarity. A run starts a tree of paths: the root splits the sets by one sampled token, and a
node that holds more than LIMIT sets is split again by PATHS tokens sampled for that node, until buckets are small enough to be compared by brute
force. A node whose sets mostly agree on the sampled tokens holds near copies, which no token parts, however often it is split; its bucket is large, and brute force
goes over it in blocks of two parts of PART sets, so that no task holds more of it. The same is done with what is left after DEPTH splits. No route drops a pair.
Runs are repeated until a pair at the threshold is met with the target recall.

Equal sets are one class from the start, so copies are counted, not compared. Brute force compares sketches first; what may be similar is
then decided on the whole texts' sets. A pair is decided only in the first bucket that both sets are in, so links are summed, never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .store import Scratch, column, tables, whole

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99999
T, PATHS, LIMIT, PART, TIGHT, DEPTH = 128, 2, 400, 160, 0.5, 8
#: Keys that hold more than one in so many of the rows are joined by broadcast; there are fewer than this.
HEAVY = 1000
#: Sketches that agree on fewer coordinates than this differ, with a chance of error of about 1e-7 at the threshold.
SKETCH_LEAST = int(T * THRESHOLD - 5.2 * math.sqrt(T * THRESHOLD * (1 - THRESHOLD)))
_SEEDS = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, (2, T), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = 4) -> int:
    """Runs until a pair at the threshold is in one bucket with the recall, if it has to survive `depth` splits below the root."""
    survives = 1.0
    for _ in range(depth):
        survives = 1 - (1 - threshold * survives) ** PATHS
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * survives))


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's texts by row, where each row's begin, and two identity hashes of each row's set. A text without words is known by its bytes."""
    n = len(offsets) - 1
    s, e, _, upto = K.words(data, offsets)
    h, of = K.shingles(K.word_hashes(data, s, e), upto, WORDS)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    first = np.searchsorted(of, np.arange(n + 1))
    identity = np.zeros((2, n), np.uint64)
    for k in range(2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h ^ np.uint64(K.BASES[k])))])
        identity[k] = total[first[1:]] - total[first[:-1]]
        for r in np.flatnonzero(first[1:] == first[:-1]):
            identity[k, r] = K.mix(K.whole_hash(data[offsets[r] : offsets[r + 1]], K.BASES[2 + k]) + np.uint64(2 * k + 1))[0]
    return h, first, identity


@K.tidy
def sketch(batches: Iterator[pa.RecordBatch], runs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        for a, b in K.blocks(offsets):
            h, first, identity = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            least = np.zeros((b - a, T), np.uint64)
            for t in range(T) if len(some) else ():
                v = (h ^ _SEEDS[0, t]) * _SEEDS[1, t]
                least[some, t] = np.minimum.reduceat(v ^ (v >> np.uint64(32)), first[some])
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * runs, pa.int32()), pa.array(K.mix(least[:, :runs]).astype(np.int64).ravel()))
            narrow = (K.mix(least) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(identity[0].astype(np.int64)), pa.array(identity[1].astype(np.int64)), pa.array(sizes), tokens, pa.array([r.tobytes() for r in narrow], pa.binary())],
                names=["doc_id", "text_hash", "c1", "c2", "n", "tokens", "sketch"],
            )


def token(node, k: int):
    """The k-th token sampled for a node, as a child's name: the coordinate depends on the node, the value on the set."""
    at = F.pmod(F.xxhash64(node, F.lit(k)), F.lit(T)).cast("int")
    return F.xxhash64(node, F.lit(k), F.substring("sketch", at + 1, F.lit(1)))


def buckets(reps: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """(leaf, members, vid): the buckets to compare. Buckets of more than `limit` members are those that can't be split."""
    runs = reps.filter("n > 0").select("vid", F.posexplode("tokens").alias("run", "t")).select("vid", F.xxhash64("run", "t").alias("node"))
    sizes = runs.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    frontier = scratch.write(runs.join(sizes, "node"), "level0")
    small = F.col("members") <= limit
    leaves = [frontier.filter(small).select(F.col("node").alias("leaf"), "members", "vid")]
    frontier = frontier.filter(~small)
    for level in range(1, DEPTH + 1):
        if frontier.limit(1).count() == 0:
            break
        held = frontier.join(reps.select("vid", "sketch"), "vid")
        split = scratch.write(held.select("node", "members", "vid", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), token(F.col("node"), k).alias("child")) for k in range(PATHS)))).alias("x")).select("node", "members", "vid", "x.k", "x.child"), f"split{level}")
        counts = split.groupBy("node", "k", "child").agg(F.count(F.lit(1)).alias("there"), F.first("members").alias("members"))
        counts = scratch.write(counts, f"counts{level}")
        whole = counts.groupBy("node", "k").agg(F.max("there").alias("most"), F.first("members").alias("members")).groupBy("node").agg((F.min(F.col("most") / F.col("members")) >= TIGHT).alias("tight"))
        whole = scratch.write(whole.filter("tight").select("node"), f"tight{level}")
        leaves.append(frontier.join(whole, "node", "left_semi").select(F.col("node").alias("leaf"), "members", "vid"))
        kids = counts.filter("there > 1").join(whole, "node", "left_anti").select(F.col("child"), F.col("there"))
        frontier = scratch.write(split.select("vid", "child").join(kids, "child").select(F.col("child").alias("node"), F.col("there").alias("members"), "vid"), f"level{level}")
        leaves.append((frontier.filter(small) if level < DEPTH else frontier).select(F.col("node").alias("leaf"), "members", "vid"))
        frontier = frontier.filter(~small)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return scratch.write(out, "leaves")


def in_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of (leaf, members, vid, ...) dealt to (leaf, block): a bucket of at most `limit` is one block; of a larger one, every pair of its parts is a block, and side tells the parts apart."""
    parts = F.when(F.col("members") <= limit, F.lit(1).cast("long")).otherwise(F.ceil(F.col("members") / F.lit(min(limit, PART))))
    own = F.pmod(F.xxhash64("vid", "leaf"), F.col("parts"))
    dealt = rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.withColumn("block", F.least("own", "other") * F.lit(1 << 24) + F.greatest("own", "other")).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)).drop("parts", "own", "other", "members")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by (leaf, block): each group, whole."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        leaf, block = t["leaf"].to_numpy(), t["block"].to_numpy()
        cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1])) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield t.slice(a, b - a)
        rest = t.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def shared_counts(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many values each two rows have in common; a row's values are distinct. Values of one row only don't matter, the others are columns of a 0/1 matrix, taken some at a time."""
    m = len(first) - 1
    rows = np.repeat(np.arange(m), np.diff(first))
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    keep = n[at] > 1
    rows, at = rows[keep], at[keep]
    number = np.cumsum(n > 1) - 1
    at = number[at]
    width = int((n > 1).sum())
    out = np.zeros((m, m), np.float32)
    step = max(64, (1 << 21) // max(m, 1))
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for a in range(0, width, step):
        i, j = np.searchsorted(at, a), np.searchsorted(at, a + step)
        x = np.zeros((m, min(step, width - a)), np.float32)
        x[rows[i:j], at[i:j] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def pairs_here(t: pa.Table) -> np.ndarray:
    """Which pairs of a block are its own: across its sides, and in no earlier bucket together."""
    side = t["side"].to_numpy()
    m = len(side)
    ok = np.triu(np.ones((m, m), bool), 1)
    if side.min() < 2:
        ok &= side[:, None] != side[None, :]
    values, first = lists(t["leaves"])
    leaf = t["leaf"][0].as_py()
    earlier = values < leaf
    if earlier.any():
        rows = np.repeat(np.arange(m), np.diff(first))
        ok &= shared_counts(values[earlier], np.searchsorted(rows[earlier], np.arange(m + 1))) == 0
    return ok


@K.tidy
def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of blocks that by their sketches may be similar to another."""
    out: list[pa.Table] = []
    n = 0
    for t in grouped(batches):
        m = t.num_rows
        if m < 2:
            continue
        data, _ = K.buffers(t["sketch"])
        x = data.reshape(m, T)
        if m <= 48:
            same = (x[:, None, :] == x[None, :, :]).sum(2)
        else:
            same = np.zeros((m, m), np.uint8)
            for c in np.ascontiguousarray(x.T):
                same += c[:, None] == c[None, :]
        sizes = t["n"].to_numpy()
        may = (same >= SKETCH_LEAST) & (np.minimum(sizes[:, None], sizes[None, :]) >= THRESHOLD * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9)
        if not (np.triu(may, 1)).any():
            continue
        may &= pairs_here(t)
        keep = np.flatnonzero(may.any(0) | may.any(1))
        if len(keep):
            out.append(t.take(pa.array(keep)).drop_columns(["sketch", "n"]))
            n += len(keep)
        if n > 5000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out, n = [], 0
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


@K.tidy
def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of a block's own pairs: for each member its links (copies counted) and, as its way into its class, the least member that it is connected with."""
    for t in grouped(batches):
        data, offsets = K.buffers(t["text"])
        h, first, identity = sets_of(data, offsets)
        # What was found by id and hash of a text is the class's if its sets are.
        own = (identity[0].astype(np.int64) == t["c1"].to_numpy()) & (identity[1].astype(np.int64) == t["c2"].to_numpy())
        vids = t["vid"].to_numpy()
        if not own.all():
            pick = np.flatnonzero(own)
            if len(pick) < 2:
                continue
            h = np.concatenate([h[first[i] : first[i + 1]] for i in pick])
            first = np.concatenate([[0], np.cumsum(np.diff(first)[pick])])
            t = t.take(pa.array(pick))
            vids = t["vid"].to_numpy()
        sizes = np.diff(first)
        inter = shared_counts(h, first)
        like = (9 * inter >= 4 * (sizes[:, None] + sizes[None, :])) & pairs_here(t)  # inter / union >= 4/5
        like |= like.T
        if not like.any():
            continue
        copies = t["copies"].to_numpy()
        links = like @ copies
        label = vids.copy()
        while True:
            least = np.minimum(label, np.where(like, label[None, :], np.iinfo(np.int64).max).min(1))
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(vids[some]), pa.array(label[some]), pa.array(links[some])], names=["vid", "to", "links"])


def joined(rows: DataFrame, values: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows with the values of their keys. `values` has one row for each key and, as there, how many rows have it at most, `total` being the sum; keys with over a HEAVY-th of it are
    fewer than HEAVY and go out by broadcast, so that their rows stay where they are and no task gets them all."""
    often = F.col("there") > F.lit(max(total // HEAVY, 1))
    heavy = F.broadcast(values.filter(often).drop("there"))
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(values.filter(~often).drop("there"), keys)
    return rest.unionByName(rows.join(heavy, keys))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vid, root) for every vertex of an edge: the least vertex of its component, by alternating large and small stars."""
    edges = scratch.write(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars0")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now, k = state(edges), 0
    while True:
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("there")).select("u", F.least("u", "m").alias("m"), "there"), f"least{k}")
        large = joined(both.filter("v > u"), least, ["u"], 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v")
        edges = scratch.write(small.distinct(), f"stars{k}")
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("u").alias("vid"), F.col("v").alias("root"))


def spread(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, class_id, n_links, text_hash and chosen for every row: links join texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, a class is what links connect, and its id is its least doc_id.

    n_links counts the other rows linked, copies included. A text of 1 to 4 words is one shingle; texts without words are linked if they are equal, nulls
    and empty texts with each other. Ids are of any type with an order. Rows that repeat an id are rows of their own. A null id is less than others. Empty tables give no rows.
    chosen marks the class's one row by its id and text_hash (xxhash64 of the text), so that rows equal in both are all marked.
    """
    spark = df.sparkSession
    scratch, runs = Scratch(spark, "ngramjoin"), runs_needed()
    docs = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = scratch.write(docs.mapInArrow(lambda x: sketch(x, runs), f"doc_id {kind}, text_hash long, c1 long, c2 long, n long, tokens array<long>, sketch binary"), "sketches")
    # A row is known by its id and its text's hash, so that rows without an id don't meet by that.
    row = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    reps = sketched.groupBy("c1", "c2", "n").agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch"))
    reps = scratch.write(reps.withColumn("vid", F.monotonically_increasing_id()), "reps")
    leaves = buckets(reps, scratch, limit)
    paths = leaves.groupBy("vid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    held = leaves.distinct().join(paths, "vid").join(reps.select("vid", "n", "sketch"), "vid")
    tasks = spread(df)
    in_order = lambda d: d.repartition(tasks, "leaf", "block").sortWithinPartitions("leaf", "block")
    may = scratch.write(in_order(in_blocks(held, limit).select("leaf", "block", "side", "vid", "leaves", "n", "sketch")).mapInArrow(candidates, "leaf long, block long, side int, vid long, leaves array<long>"), "candidates")
    wanted = reps.join(may.select("vid").distinct(), "vid", "left_semi").select("vid", "c1", "c2", "copies", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"))
    same = docs["text_hash"].eqNullSafe(F.col("rep_h")) & docs["doc_id"].eqNullSafe(F.col("rep_id"))
    # Rows equal in id and text are one text; they are reduced before the shuffle.
    texts = docs.join(wanted, same).groupBy("vid").agg(*(F.first(c).alias(c) for c in ("c1", "c2", "copies", "text")))
    decided = in_order(may.join(texts, "vid").select("leaf", "block", "side", "vid", "leaves", "c1", "c2", "copies", "text"))
    decided = scratch.write(decided.mapInArrow(decide, "vid long, to long, links long"), "decided")
    roots = components(decided.select(F.col("vid").alias("u"), F.col("to").alias("v")), scratch)
    classes = reps.select("vid", "c1", "c2", "rep", "copies").join(decided.groupBy("vid").agg(F.sum("links").alias("links")), "vid", "left").join(roots, "vid", "left")
    classes = scratch.write(classes.withColumn("root", F.coalesce("root", "vid")), "roots")
    firsts = scratch.write(classes.groupBy("root").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("there")), "firsts")
    n_sets, n_rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    classes = joined(classes, firsts, ["root"], n_sets).select("c1", "c2", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("there"))
    classes = scratch.write(classes, "classes")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.h"))
    return joined(sketched.select("doc_id", "text_hash", "c1", "c2"), classes, ["c1", "c2"], n_rows).select("doc_id", F.col("first.id").alias("class_id"), "n_links", "text_hash", chosen.alias("chosen"))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(tables(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are chosen for their classes; of rows equal in id and text, one. Rows with a null id have no class to lose by and stay."""
    kept = classes.filter("chosen and doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    rows = whole(docs).select("row", F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col]).alias("h"))
    out = rows.join(kept.filter("n = 1"), ["id", "h"], "left_semi").select("row").unionByName(rows.filter("id is null").select("row"))
    if kept.filter("n > 1").limit(1).count():
        again = rows.join(kept.filter("n > 1").select("id", "h"), ["id", "h"])
        out = out.unionByName(again.groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return out.select("row.*")
