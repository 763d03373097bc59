"""Divergence of sources within a language, from mergeable radix tries.

Every task counts the terms of its documents in one byte trie a language: a leaf has the number of documents that hold the term and a
counter for each source. A trie that grows large is written out in UTF-8 order, as pages of leaves. Languages are then cut into
ranges of prefixes of about equal numbers of leaves; pages are cut there, and each range's pages merged into one trie, whose leaves of enough
documents are written in UTF-8 order again. A last pass over the merged leaves streams the pairs of sources that share a
term, and the candidates of each source: as it goes upwards, of equal candidates the first one stays.

Two sources differ in a term as far as the shares there differ. Terms that a source lacks all have one share in it, and a share depends
on nothing but the count; so the sum for a pair of sources over all terms is one over the terms that both have, one over either's numbers of terms of each count, and a constant.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import kernels as K
from .store import Scratch, column, tables
from .terms import LETTERS, occurrences

LEAST_DOCUMENTS, BEST_TERMS, SCALE = 3, 200, 1_000_000_000
#: Leaf counters of a task's tries before they are written out, leaves of a page, written leaves of a range.
HELD, PAGE, RANGE = 400_000, 1024, 65_536
#: Pages of a batch.
GATHERED = 64
#: Ranges of a language at most. They need not grow with the input: a merge keeps one leaf a term, however many pages have it.
MOST_RANGES = 20_000
#: Pairs of sources in a term that are worked on at once, and sums that a task holds.
PAIRS, SUMS = 1 << 20, 1 << 20

PAGES = StructType([
    StructField("lang", StringType()), StructField("at", LongType()), StructField("last", LongType()), StructField("terms", ArrayType(BinaryType())), StructField("documents", ArrayType(LongType())),
    StructField("width", ArrayType(IntegerType())), StructField("source", ArrayType(IntegerType())), StructField("n", ArrayType(LongType())), StructField("names", ArrayType(StringType())),
])


def key(term: bytes) -> int:
    """The first 7 bytes as a number: terms are cut into ranges by it."""
    return int.from_bytes(term[:7].ljust(7, b"\0"), "big")


def gathered(make):
    """For functions that give pages one by one: GATHERED of them leave in one batch, since each batch has its own cost."""

    def together(*args) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for page in make(*args):
            held.append(page)
            if len(held) >= GATHERED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return together


class Trie:
    """A radix trie of byte strings in steps of two bytes, three bytes and what is left. Leaves are numbered as they come; their counters stand in arrays beside it."""

    def __init__(self) -> None:
        self.root: dict[bytes, dict[bytes, dict[bytes, int]]] = {}
        self.size = 0

    def leaves(self, terms: list[bytes]) -> list[int]:
        """The numbers of the terms' leaves, which are made where there are none."""
        out, root, n = [], self.root, self.size
        for term in terms:
            a, b, c = term[:2], term[2:5], term[5:]
            node = root.get(a)
            if node is None:
                node = root[a] = {}
            end = node.get(b)
            if end is None:
                end = node[b] = {}
            leaf = end.setdefault(c, n)
            if leaf == n:
                n += 1
            out.append(leaf)
        self.size = n
        return out

    def walk(self) -> tuple[list[bytes], list[int]]:
        """Terms and their leaves, in UTF-8 order: a step is shorter than the others' only where the term ends, and then comes first."""
        terms, leaves = [], []
        for a in sorted(self.root):
            node = self.root[a]
            for b in sorted(node):
                end, path = node[b], a + b
                if len(end) == 1:
                    for c, leaf in end.items():
                        terms.append(path + c)
                        leaves.append(leaf)
                else:
                    for c in sorted(end):
                        terms.append(path + c)
                        leaves.append(end[c])
        return terms, leaves


class Counters:
    """A trie of one language, the numbers of documents of its leaves, and their counters a source."""

    def __init__(self) -> None:
        self.trie, self.number = Trie(), {}
        self.documents: list[tuple[np.ndarray, np.ndarray]] = []  # leaves, documents
        self.uses: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # leaves, sources, counts

    def settle(self) -> None:
        """Adds up what is held: one entry a leaf, and one a leaf and source."""
        leaf, d = (np.concatenate(x) for x in zip(*self.documents, strict=True))
        total = np.zeros(self.trie.size, np.int64)
        np.add.at(total, leaf, d)
        self.documents = [(np.arange(self.trie.size), total)]
        leaf, source, n = (np.concatenate(x) for x in zip(*self.uses, strict=True))
        cell, at = np.unique(leaf * len(self.number) + source, return_inverse=True)
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, at, n)
        self.uses = [(cell // len(self.number), cell % len(self.number), total)]

    def pages(self, lang: str, place: int | None, least: int = 1, size: int = PAGE) -> Iterator[pa.RecordBatch]:
        """Pages of the leaves of enough documents, in UTF-8 order; each names only its own sources."""
        terms, order = self.trie.walk()
        if not terms:
            return
        n = len(terms)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        documents = np.zeros(n, np.int64)
        for leaf, d in self.documents:
            np.add.at(documents, rank[leaf], d)
        leaf, source, uses = (np.concatenate(x) for x in zip(*self.uses, strict=True))
        names = list(self.number)
        cell, at = np.unique(rank[leaf] * len(names) + source, return_inverse=True)
        counts = np.zeros(len(cell), np.int64)
        np.add.at(counts, at, uses)
        enough = documents >= least
        counts, cell = counts[enough[cell // len(names)]], cell[enough[cell // len(names)]]
        width = np.bincount(cell // len(names), minlength=n)[enough]
        source, documents = cell % len(names), documents[enough]
        terms = terms if enough.all() else [t for t, x in zip(terms, enough.tolist(), strict=True) if x]
        first = np.append(0, np.cumsum(width))
        for a in range(0, len(terms), size):
            b = min(a + size, len(terms))
            own, local = np.unique(source[first[a] : first[b]], return_inverse=True)
            values = [pa.array([lang]), pa.array([key(terms[a]) if place is None else place], pa.int64()), pa.array([key(terms[b - 1])], pa.int64())]
            lists = pa.array(terms[a:b], pa.binary()), pa.array(documents[a:b]), pa.array(width[a:b].astype(np.int32)), pa.array(local.astype(np.int32)), pa.array(counts[first[a] : first[b]]), pa.array([names[s] for s in own], pa.string())
            yield pa.RecordBatch.from_arrays([*values, *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], schema=ARROW)


ARROW = pa.schema([
    ("lang", pa.string()), ("at", pa.int64()), ("last", pa.int64()), ("terms", pa.list_(pa.binary())), ("documents", pa.list_(pa.int64())),
    ("width", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("names", pa.list_(pa.string())),
])


@K.tidy
@gathered
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of the tries of this task, one trie a language: counters of terms a source, and of documents a language, become leaves when there are many or at the end."""
    uses: dict[str, dict[str, Counter]] = {}
    documents: dict[str, Counter] = {}
    seen = 0

    def written() -> Iterator[pa.RecordBatch]:
        for lang, of_lang in uses.items():
            c, d = Counters(), documents[lang]
            leaf = dict(zip(d, c.trie.leaves(list(d)), strict=True))
            numbers = lambda x: np.fromiter(x, np.int64, len(x))
            c.documents.append((numbers(leaf.values()), numbers(d.values())))
            for source, n in of_lang.items():
                number = c.number.setdefault(source, len(c.number))
                c.uses.append((np.fromiter(map(leaf.__getitem__, n), np.int64, len(n)), np.full(len(n), number, np.int64), numbers(n.values())))
            yield from c.pages(lang, None)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            mine, all_documents = uses.setdefault(lang, {}).setdefault(source, Counter()), documents.setdefault(lang, Counter())
            before, found = len(mine), occurrences(text.as_py(), LETTERS)
            mine.update(found)
            all_documents.update(set(found))
            seen += len(mine) - before
            if seen >= HELD:
                yield from written()
                uses, documents, seen = {}, {}, 0
    yield from written()


def keys_of(terms: pa.BinaryArray) -> np.ndarray:
    """key() of many terms."""
    _, offsets, data = terms.buffers()
    at = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(7, np.uint8))
    out = np.zeros(len(terms), np.int64)
    for k in range(7):
        out = out << 8 | np.where(at[:-1] + k < at[1:], raw[at[:-1] + k], 0)
    return out


@K.tidy
@gathered
def cut(batches: Iterator[pa.RecordBatch], borders: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pages cut at the borders of ranges; `at` becomes the range."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        lo, hi = (np.array([np.searchsorted(borders[lang], a, "right") for lang, a in zip(langs, batch.column(c).to_pylist(), strict=True)], np.int64) for c in (1, 2))
        if (lo == hi).any():
            yield batch.filter(pa.array(lo == hi)).set_column(1, "at", pa.array(lo[lo == hi]))
        for row in np.flatnonzero(lo != hi):
            page = {name: batch.column(name)[row] for name in batch.schema.names}
            terms, documents, width, source, n = (page[c].values for c in ("terms", "documents", "width", "source", "n"))
            ranges = np.searchsorted(borders[langs[row]], keys_of(terms), "right")
            first = np.append(0, np.cumsum(width.to_numpy()))
            ends = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for a, b in zip(ends, ends[1:], strict=False):
                x, y = int(first[a]), int(first[b])
                values = [pa.array([langs[row]]), pa.array([int(ranges[a])], pa.int64()), pa.array([page["last"].as_py()], pa.int64())]
                values += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (terms.slice(a, b - a), documents.slice(a, b - a), width.slice(a, b - a), source.slice(x, y - x), n.slice(x, y - x), page["names"].values)]
                yield pa.RecordBatch.from_arrays(values, schema=ARROW)


@K.tidy
@gathered
def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pages come ordered by language and range: each range's become one trie, of which leaves of enough documents stay."""
    of, held = None, Counters()

    for batch in batches:
        for row in range(batch.num_rows):
            lang, at, terms, documents, width, source, n, names = (batch.column(c)[row] for c in ("lang", "at", "terms", "documents", "width", "source", "n", "names"))
            if of != (lang.as_py(), at.as_py()):
                if of:
                    yield from held.pages(*of, least)
                of, held = (lang.as_py(), at.as_py()), Counters()
            leaves = np.array(held.trie.leaves(terms.as_py()), np.int64)
            local = np.array([held.number.setdefault(s, len(held.number)) for s in names.as_py()], np.int64)
            held.documents.append((leaves, documents.values.to_numpy()))
            held.uses.append((np.repeat(leaves, width.values.to_numpy()), local[source.values.to_numpy()], n.values.to_numpy()))
            if len(held.uses) >= 1000:
                held.settle()
    if of:
        yield from held.pages(*of, least)


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), digit by digit: exact up to totals of nine quadrillion."""
    out, rest = np.zeros(len(n), np.int64), n + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def differs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


@K.tidy
def streamed(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """Of merged pages with their language's sources, their totals N + V and the language's own: for each two sources the sum over terms that both have of what they differ there beyond what the other sums count, and each source's best terms."""
    sums: dict[tuple[str, str, str], int] = {}
    heaps: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

    def told(every: bool) -> Iterator[pa.RecordBatch]:
        """Gives out what is held, if it is much or the end."""
        nonlocal sums, heaps
        if every or len(sums) + best * len(heaps) > SUMS:
            rows = [(lang, a, "pair", b, v) for (lang, a, b), v in sums.items()]
            rows += [(lang, a, "term", (~np.frombuffer(t[:-1], np.uint8)).tobytes().decode(), v) for (lang, a), h in heaps.items() for v, t in h]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), FOUND, strict=True)], schema=FOUND)
            sums, heaps = {}, {}

    for batch in batches:
        for row in range(batch.num_rows):
            page = {name: batch.column(name)[row] for name in batch.schema.names}
            lang, names, all_names = page["lang"].as_py(), page["names"].as_py(), page["sources"].as_py()
            place = {s: i for i, s in enumerate(all_names)}
            local = np.array([place[s] for s in names], np.int64)
            totals = np.array(page["totals"].as_py(), np.int64)
            terms, width = page["terms"].values, page["width"].values.to_numpy().astype(np.int64)
            source, n = page["source"].values.to_numpy(), page["n"].values.to_numpy()
            of = np.repeat(np.arange(len(width)), width)
            p, none = share(n, totals[local[source]]), share(np.zeros(len(names), np.int64), totals[local])
            first = np.cumsum(width) - width
            # Candidates: above the language's share of the term.
            together = share(np.add.reduceat(n, first), np.full(len(width), page["total"].as_py(), np.int64))
            above = np.flatnonzero(p > together[of])
            value = differs(p[above], together[of[above]])
            for i in np.lexsort((of[above], -value, source[above])):
                heap, v = heaps.setdefault((lang, names[source[above[i]]]), []), int(value[i])
                if len(heap) < best or v >= heap[0][0]:
                    # Of equal values the term that comes first is the better one: bytes are turned round, and end above all others.
                    entry = v, (~np.frombuffer(terms[int(of[above[i]])].as_py(), np.uint8)).tobytes() + b"\xff"
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            # Pairs: every two counters of a leaf, some counters with all their partners at a time.
            partners = width[of]
            upto = np.cumsum(partners)
            a = 0
            while a < len(of):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] - partners[a] + PAIRS, "right")))
                x = np.repeat(np.arange(a, b), partners[a:b])
                y = first[of[x]] + np.arange(len(x)) - np.repeat(upto[a:b] - partners[a:b] - (upto[a] - partners[a]), partners[a:b])
                x, y = x[x != y], y[x != y]
                sx, sy = source[x], source[y]
                more = differs(p[x], p[y]) - differs(p[x], none[sy]) - differs(none[sx], p[y]) + differs(none[sx], none[sy])
                pair, at = np.unique(sx.astype(np.int64) * len(names) + sy, return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, more)
                for k, v in zip(pair.tolist(), total.tolist(), strict=True):
                    who = lang, names[k // len(names)], names[k % len(names)]
                    sums[who] = sums.get(who, 0) + v
                a = b
            yield from told(False)
    yield from told(True)


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, best: int = BEST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair` has a row for each ordered two sources of a language, part `term` the `best` terms (ties by UTF-8) that a source has more of than its language. Terms in fewer than `least` documents of a language play no part. Nulls are empty strings;
    a source without terms, or a language without kept ones, has its pairs nevertheless. Repeated rows are documents each. An empty table gives no rows. Other columns play no part.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "divergence")
    text = lambda name: F.coalesce(column(name).cast("string"), F.lit(""))
    docs = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    pages = scratch.write(docs.mapInArrow(counted, PAGES), "counted")
    # One row a language, whose borders are at most MOST_RANGES numbers.
    sizes = {r[0]: r[1] for r in pages.groupBy("lang").agg(F.sum(F.size("terms"))).collect()}
    borders = {}
    for lang, n in sizes.items():
        k = min(MOST_RANGES, n // RANGE)
        # Pages have about as many leaves each: their first terms are spread as all terms are.
        got = pages.filter(F.col("lang") == lang).agg(F.percentile_approx("at", [i / (k + 1) for i in range(1, k + 1)], 5 * k + 1000)).first()[0] if k else []
        borders[lang] = np.unique(np.array(got, np.int64))
    sent = spark.sparkContext.broadcast(borders)
    ranged = pages.mapInArrow(lambda x: cut(x, sent.value), PAGES)
    trie = scratch.write(ranged.repartition("lang", "at").sortWithinPartitions("lang", "at").mapInArrow(lambda x: merged(x, least), PAGES), "merged")
    # How many kept terms each source has with each count: few rows, since most terms are rare and most counts small.
    each = trie.select("lang", "names", F.explode(F.arrays_zip("source", "n")).alias("x")).select("lang", F.get("names", F.col("x.source")).alias("source"), F.col("x.n").alias("n"))
    counts = scratch.write(each.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "counts")
    groups = docs.select("lang", "source").distinct()
    kept = trie.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    of_source = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("of_source"))
    groups = groups.join(of_source, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", (F.coalesce("of_source", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = scratch.write(groups, "groups")
    by_lang = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("s"), (F.sum(F.col("total") - F.col("v")) + F.max("v")).alias("total"))
    by_lang = by_lang.select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), "total")
    found_schema = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("part", StringType()), StructField("item", StringType()), StructField("value", LongType())])
    given = trie.join(by_lang, "lang").select("lang", "terms", "width", "source", "n", "names", "sources", "totals", "total")
    found = scratch.write(given.mapInArrow(lambda x: streamed(x, best), found_schema), "found")
    p = lambda n, total: F.expr(f"1L + (cast({n} + 1 AS decimal(20,0)) * {SCALE}) div cast({total} AS decimal(20,0))")
    f = lambda p, q: F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")
    none = groups.select("lang", "source", "total", "v", F.when(F.col("v") > 0, p("0", "total")).alias("none"))
    one, other = none.select("lang", F.col("source").alias("a"), F.col("none").alias("pa"), "v"), none.select("lang", F.col("source").alias("b"), F.col("none").alias("pb"))
    pairs = one.join(other, "lang").filter("a <> b")
    constant = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.when(F.col("v") > 0, F.col("v") * f("pa", "pb")).otherwise(0).alias("value"))
    mine = counts.join(groups.select("lang", "source", "total"), ["lang", "source"]).select("lang", F.col("source").alias("s"), "terms", p("n", "total").alias("p"), p("0", "total").alias("p0"))
    rest = none.filter("v > 0").select("lang", F.col("source").alias("t"), F.col("none").alias("q"))
    both = mine.join(rest, "lang").filter("s <> t")
    as_first = both.groupBy("lang", "s", "t").agg(F.sum(F.col("terms") * (f("p", "q") - f("p0", "q"))).alias("value")).select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value")
    as_other = both.groupBy("lang", "s", "t").agg(F.sum(F.col("terms") * (f("q", "p") - f("q", "p0"))).alias("value")).select("lang", F.col("t").alias("source"), F.col("s").alias("item"), "value")
    shared = found.filter("part = 'pair'").select("lang", "source", "item", "value")
    pair = constant.unionByName(as_first).unionByName(as_other).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    term = found.filter("part = 'term'")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("rank", rank).select(columns).unionByName(term.withColumn("rank", rank).filter(F.col("rank") <= best).select(columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(tables(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
o AS (SELECT rid, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
ng AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
nl AS (SELECT lang, sum(n)::HUGEINT AS n FROM ng GROUP BY lang),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (ng.n + v.v))::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN ng USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (sum(c.n) + 1)) // (nl.n + v.v))::HUGEINT AS q FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY lang, term, nl.n, v.v),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
best AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM best) WHERE rank <= {BEST_TERMS}
"""
