"""Ranked lexical search, score at a time.

One pass over the documents keeps, for each, its number of terms and the frequencies of those terms that the items ask for. Once the
corpus counts are known, every task makes segments of what it has: postings sorted by term and, within a term, by descending exact
impact. An item takes its terms' postings in levels: all groups of equal impact whose contribution (weight times impact) reaches the
level, which falls by a quarter each time. It stops only when no document that is met first from here on can reach the k-th best score: the sum of what each
term's next posting contributes is below it. Documents that could still be among the best then get their scores completed from all their postings.
A task carries each item's best from segment to segment, so that later ones stop early; at most k rows an item leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import kernels as K
from .store import Scratch, column, tables
from .terms import LETTERS_AND_DIGITS, count

BEST, SCALE, EDGE, SLOPE = 10, 1_000_000_000, 100, 75
#: Bytes of the terms that are broadcast at once, and postings of a segment.
BLOCK_BYTES, SEGMENT_POSTINGS = 1 << 24, 1 << 21
#: Postings are sorted by term << 20 | TOP - impact; impacts are at most SCALE / 1000.
BITS, TOP = 20, (1 << 20) - 1
SALTS = 32


@K.tidy
def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, term, times) of items (q, text)."""
    for batch in batches:
        q, term, times = [], [], []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counted = count(text.as_py(), LETTERS_AND_DIGITS)
            q += [n] * len(counted)
            term += counted
            times += counted.values()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], names=["q", "term", "times"])


@K.tidy
def forward(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, tfs): of every document with a term, all its terms counted, and the frequencies of those in the vocabulary."""
    for batch in batches:
        kept, n, first, terms, tfs = [], [], [0], [], []
        for row, text in enumerate(batch.column(1)):
            counted = count(text.as_py(), LETTERS_AND_DIGITS)
            if counted:
                kept.append(row)
                n.append(counted.total())
                found = counted.keys() & vocabulary.keys()
                terms += map(vocabulary.__getitem__, found)
                tfs += map(counted.__getitem__, found)
                first.append(len(terms))
        offsets = pa.array(first, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + sizes[i] - 1, one range behind the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    if int(n.max(initial=0)) * documents * SLOPE < 1 << 63:
        return EDGE - SLOPE + (SLOPE * documents * n) // terms
    return np.array([EDGE - SLOPE + (SLOPE * documents * int(x)) // terms for x in n], np.int64)


class Segment:
    """Documents of one task: their postings by document, and by term and descending impact."""

    def __init__(self, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, total: int) -> None:
        self.ids, self.size = ids, len(n)
        self.first, self.sizes, self.terms = np.cumsum(sizes) - sizes, sizes, terms.astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        self.impacts = SCALE * tfs // (1000 * tfs + 8 * length_factor(n, documents, total)[doc])
        key = self.terms << BITS | (TOP - self.impacts)
        order = np.argsort(key, kind="stable")
        self.key, self.doc = key[order], doc[order]
        self.id_order = np.empty(len(n), np.int64)
        self.id_order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(n))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (best first, at most k, equal scores by id) and scores of those with at least `floor`. weight_of: zeros for every term; it is handed back so."""
        score = np.zeros(self.size, np.int64)
        at, end = np.searchsorted(self.key, terms << BITS), np.searchsorted(self.key, (terms + 1) << BITS)
        last = max(len(self.key) - 1, 0)
        while True:
            heads = np.where(at < end, weights * (TOP - (self.key[np.minimum(at, last)] & TOP)), 0) if len(self.key) else np.zeros(len(terms), np.int64)
            bound = int(heads.sum())
            if bound < floor:
                break
            level = max(int(heads.max()) * 3 // 4, 1)
            upto = np.clip(np.searchsorted(self.key, (terms << BITS) + TOP - np.minimum(-(-level // weights), TOP), "right"), at, end)
            which = ranges(at, upto - at)
            np.add.at(score, self.doc[which], np.repeat(weights, upto - at) * (TOP - (self.key[which] & TOP)))
            at = upto
            if self.size > k:
                floor = max(floor, int(np.partition(score, self.size - k)[self.size - k]))
        may = np.flatnonzero(score + bound >= floor)
        if bound:  # complete the scores of those that have postings left
            which = ranges(self.first[may], self.sizes[may])
            weight_of[terms] = weights
            upto = np.append(0, np.cumsum(weight_of[self.terms[which]] * self.impacts[which]))
            weight_of[terms] = 0
            ends = np.cumsum(self.sizes[may])
            full = upto[ends] - upto[ends - self.sizes[may]]
        else:
            full = score[may]
        may, full = may[full >= floor], full[full >= floor]
        order = np.lexsort((self.id_order[may], -full))[:k]
        return may[order], full[order]


def in_order(x: tuple[int, object]) -> tuple:
    """Best score first, then ids ascending, a null one first."""
    return (-x[0], x[1] is not None, x[1])


@K.tidy
def best_of_task(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray, np.ndarray]], words: int, k: int, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """(q, score, doc_id): each item's k best of this task's documents. items: (q, its terms, their weights)."""
    best: list[list[tuple[int, object]]] = [[] for _ in items]
    weight_of, held, postings, kind = np.zeros(words, np.int64), [], 0, pa.int64()

    def searched() -> None:
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        ids, terms = t["doc_id"].chunk(0), t["terms"].chunk(0)
        segment = Segment(ids, t["n"].to_numpy(), terms.value_lengths().to_numpy().astype(np.int64), terms.flatten().to_numpy(), t["tfs"].chunk(0).flatten().to_numpy(), documents, total)
        for i, (_, mine, weights) in enumerate(items):
            docs, scores = segment.search(mine, weights, k, best[i][-1][0] if len(best[i]) == k else 1, weight_of)
            if len(docs):
                best[i] = sorted([*best[i], *zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True)], key=in_order)[:k]

    for batch in batches:
        kind = batch.column(0).type
        widths = np.cumsum(batch.column(2).value_lengths().to_numpy())
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(widths, (widths[a - 1] if a else 0) + SEGMENT_POSTINGS, "right")))
            held.append(batch.slice(a, b - a))
            postings += int(widths[b - 1] - (widths[a - 1] if a else 0))
            a = b
            if postings >= SEGMENT_POSTINGS:
                searched()
                held, postings = [], 0
    if held:
        searched()
    rows = [(items[i][0], score, doc) for i, found in enumerate(best) for score, doc in found]
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind), strict=True)], names=["q", "score", "doc_id"])


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Index:
    """What a search needs of the documents for one vocabulary: the forward table, and N, L and each term's df."""

    def __init__(self, docs: DataFrame, vocabulary: dict[bytes, int], scratch: Scratch, name: str) -> None:
        sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # BLOCK_BYTES of terms, or those of one item
        schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(LongType()))])
        self.vocabulary = vocabulary
        self.table = scratch.write(docs.mapInArrow(lambda x: forward(x, sent.value), schema), name)
        self.documents, self.total = self.table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # A row a term of the vocabulary.
        self.df = {r[0]: r[1] for r in self.table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}

    def search(self, asked: list[tuple[int, bytes, int]], k: int) -> DataFrame:
        """(q, score, doc_id) of asked (q, term, times); at most k rows an item and task."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for q, term, times in asked:
            t = self.vocabulary[term]
            if weight := times * term_weight(self.documents, self.df.get(t, 0)) if t in self.df else 0:
                by_item.setdefault(q, []).append((t, weight))
        items = [(q, *(np.array(x, np.int64) for x in zip(*sorted(terms), strict=True))) for q, terms in by_item.items()]
        sent = self.table.sparkSession.sparkContext.broadcast(items)
        words, documents, total = len(self.vocabulary), self.documents, self.total
        schema = StructType([StructField("q", LongType()), StructField("score", LongType()), StructField("doc_id", self.table.schema["doc_id"].dataType)])
        return self.table.mapInArrow(lambda x: best_of_task(x, sent.value, words, k, documents, total), schema)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item; equal scores by ascending doc_id, a null one first.

    A null or empty text has no terms: such a document is not counted, such an item finds nothing. Every row of either table counts for itself,
    so repeated documents take a rank each and a repeated item has its ranks again. Ids are of any type that sorts. An empty table gives no rows. Other columns play no part.
    Items are the stated query set. Where their terms fit into `block_bytes` the documents are read once; else items are dealt into blocks of about that size, one pass each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "impacts")
    docs = docs.select(column(doc_id).alias("doc_id"), column(doc_text).cast("string").cast("binary").alias("text"))
    asked = scratch.write(items.select(F.monotonically_increasing_id().alias("q"), column(item_id).alias("item_id"), column(item_text).cast("string").cast("binary").alias("text")), "items")
    schema = StructType([StructField("q", LongType()), StructField("term", BinaryType()), StructField("times", LongType())])
    terms = scratch.write(asked.select("q", "text").mapInArrow(item_terms, schema), "terms")
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    blocks = 1 + size(terms) // block_bytes
    words = terms.select("term").distinct()
    shared = Index(docs, {bytes(r[0]): i for i, r in enumerate(words.collect())}, scratch, "forward") if size(words) <= block_bytes else None
    found = None
    for b in range(blocks):
        mine = [(r[0], bytes(r[1]), r[2]) for r in terms.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()]
        index = shared or Index(docs, {t: i for i, t in enumerate(sorted({x[1] for x in mine}))}, scratch, f"forward{b}")
        part = index.search(mine, k)
        found = part if found is None else found.unionByName(part)
    best_first = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # First the best of each SALTS-th of the tasks, so that no place sees what all of them found for an item.
    few = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*best_first))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best_first))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT rid, doc_id, len(t)::HUGEINT AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*)::HUGEINT AS nn, sum(n)::HUGEINT AS ll FROM docs),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS.format("text")} AS t FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, nn),
m AS (SELECT rid, doc_id, ({EDGE - SLOPE} + ({SLOPE} * n * nn) // ll)::BIGINT AS m FROM docs, totals),
s AS (
  SELECT qid, item_id, rid, doc_id, sum(times * w * (({SCALE} * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
WHERE rank <= {BEST}
"""
