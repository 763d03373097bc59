"""Merkle fixity audit of WARC archives.

Records lie in an archive in a fixed order; a record's leaf is the SHA-256 of its bytes. Leaves are hashed by ranges of offsets into
nodes, nodes by FANOUT into higher ones (files are one of the levels), up to one root of the archive; trees are as high as their archives need. Two replicas' trees are compared from the top: only children of
nodes that differ are read and compared, and under the lowest differing nodes the records are told apart. A second replica is hashed whole; its leaves take the
manifest's offsets by record id, so a record that is lost or has another length moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch, tables

RANGE_BYTES, FANOUT, FILE_LEVEL, SEGMENT_ROWS = 1 << 16, 16, 4, 20_000
#: A file holds the records that start in a span of so many bytes.
FILE_BYTES = RANGE_BYTES * FANOUT ** (FILE_LEVEL - 1)


def record(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.0 response record as bytes. Nulls are empty."""
    body, end = F.coalesce(body, F.lit("")), "\r\n"
    head = F.concat(
        F.lit(f"WARC/1.0{end}WARC-Type: response{end}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{end}WARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">{end}Content-Length: "), F.octet_length(body).cast("string"), F.lit(end + end),
    )
    return F.concat(head, body, F.lit(end + end)).cast("binary")


def ranged(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows, written in ranges of their order: part is a range's number and tie the place of a row before, which tells equal rows apart, so that no task gets what shares an id whole."""
    kept = scratch.write(rows, name)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // SEGMENT_ROWS))
    return scratch.write(kept.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie").withColumn("part", F.spark_partition_id()), f"{name}-ranged")


def numbered(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """k (from 1): a row's number among those of its group. A range numbers its own rows; to those of a group that began in earlier ranges, of which a range has one at most, the rows there are added."""
    dealt = ranged(rows, [*group, *order], scratch, name)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part", *group).agg(F.count(F.lit(1)).alias("there_are")).select(F.col("part").alias("at"), F.struct(*group).alias("of"), F.sum("there_are").over(earlier).alias("before")).filter("before is not null")
    k = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order, "tie"))
    out = dealt.withColumn("k", k).join(F.broadcast(before), (F.col("part") == F.col("at")) & F.struct(*group).eqNullSafe(F.col("of")), "left")
    return out.select(*rows.columns, (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"))


def archive(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The archive's index: record_id, offset, length, digest, for every row; the order is that of md5(id), then id and digest. Offsets are sums of lengths over ranges of this order."""
    rows = pages.select(F.col(id_col).alias("record_id"), record(F.col(url_col), F.col(id_col), F.col(html_col)).alias("bytes"))
    rows = rows.select("record_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"), F.md5(F.coalesce(F.col("record_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    order = ["h", "record_id", "digest"]
    dealt = ranged(rows, order, Scratch(pages.sparkSession, "archive"), "hashed")
    inside = Window.partitionBy("part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, 0)
    starts = dealt.groupBy("part").agg(F.sum("length").alias("there"))  # one row a range
    starts = starts.select("part", (F.sum("there").over(Window.orderBy("part")) - F.col("there")).alias("before"))
    return dealt.withColumn("upto", F.sum("length").over(inside)).join(starts, "part").select("record_id", (F.col("before") + F.col("upto") - F.col("length")).alias("offset"), "length", "digest")


def nodes(below: DataFrame, key: Column, *names: str) -> DataFrame:
    """One node for each value of key over what is below: the SHA-256 of its ordered (number, digest) list. A node has FANOUT children or the records of RANGE_BYTES, so the list is short."""
    children = F.array_sort(F.collect_list(F.struct("number", "digest")))
    return below.groupBy(key.alias("number_up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["number"].cast("string"), c["digest"])), ",").cast("binary"), 256).alias("digest")).withColumnRenamed("number_up", "number")


def height(*indexes: DataFrame) -> int:
    """Levels above the records, so that the highest has one node: the root."""
    end = max(x.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for x in indexes)
    k = FILE_LEVEL
    while end // (RANGE_BYTES * FANOUT ** (k - 1)):
        k += 1
    return k


def tree(index: DataFrame, scratch: Scratch, name: str, levels: int) -> list[DataFrame]:
    """Levels of (number, digest), from records (by offset) to the root; each is a table of its own, so that an audit reads what it descends to."""
    leaf = scratch.write(index.select("record_id", F.col("offset").alias("number"), "length", "digest"), f"{name}-records")
    out = [leaf, scratch.write(nodes(leaf.select("number", "digest"), F.floor(F.col("number") / F.lit(RANGE_BYTES))), f"{name}-1")]
    for k in range(2, levels + 1):
        out.append(scratch.write(nodes(out[-1], F.floor(F.col("number") / F.lit(FANOUT))), f"{name}-{k}"))
    return out


def root(levels: list[DataFrame]) -> str | None:
    """The archive's digest, the one node of the highest level; None of an empty archive."""
    got = levels[-1].select("digest").first()
    return got and got[0]


def audit(a: list[DataFrame], b: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Records that differ between two replicas' trees of one height: file, offset, length, record_id, status (corrupt, missing or extra in b), digest_a, digest_b. Each level's differing nodes are written, so a level is planned once."""

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.alias("y"), "number", "full").filter(~F.col("x.digest").eqNullSafe(F.col("y.digest")))

    wrong = scratch.write(differing(a[-1], b[-1]).select("number"), "wrong")
    for k in range(len(a) - 2, -1, -1):
        up = F.floor(F.col("number") / F.lit(FANOUT if k else RANGE_BYTES))
        under = [t.join(wrong.select(F.col("number").alias("up")), up == F.col("up"), "left_semi") for t in (a[k], b[k])]
        wrong = differing(*under) if not k else scratch.write(differing(*under).select("number"), f"wrong-{k}")
    return wrong.select(
        F.floor(F.col("number") / F.lit(FILE_BYTES)).cast("long").alias("file"), F.col("number").alias("offset"), F.coalesce("x.length", "y.length").alias("length"), F.coalesce("x.record_id", "y.record_id").alias("record_id"),
        F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "extra").otherwise("corrupt").alias("status"), F.col("x.digest").alias("digest_a"), F.col("y.digest").alias("digest_b"),
    )


def placed(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """A second copy's index with the manifest's offsets (the first one's), matched by record id, so that a lost or resized record doesn't shift those after it.

    Of several records of one id those with equal digests are matched first, the others in the order of digests. What the manifest doesn't have lies behind its end.
    """
    scratch = Scratch(index.sparkSession, "placed")
    end = manifest.agg(F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0))).first()[0]
    both = index.select("*", F.lit(None).cast("long").alias("there")).unionByName(manifest.select("*", F.col("offset").alias("there"))).withColumn("own", F.col("there").isNull())
    alike = Window.partitionBy("record_id", "digest", "k")  # one row of each copy
    both = numbered(both, ["record_id", "digest", "own"], ["offset"], scratch, "equal").withColumn("same", F.count(F.lit(1)).over(alike) == 2).withColumn("met", F.max("there").over(alike))
    both = scratch.write(both.drop("k"), "met")
    rest = numbered(both.filter("not same").drop("met"), ["record_id", "own"], ["digest", "offset"], scratch, "rest").withColumn("met", F.max("there").over(Window.partitionBy("record_id", "k")))
    found = both.filter("own and same").select("record_id", "met", "offset", "length", "digest").unionByName(rest.filter("own").select("record_id", "met", "offset", "length", "digest"))
    return found.select("record_id", F.coalesce("met", F.col("offset") + F.lit(end)).alias("offset"), "length", "digest")


def damaged(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The pages of a second copy of the archive, for the query: ids of remainder 7 by 41 have another first character, ids of remainder 13 by 97 are lost."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    changed = F.when(F.col(id_col) % 41 == 7, F.concat(F.lit("?"), F.substring(body, 2, 1 << 30))).otherwise(F.col(html_col))
    return pages.filter(~F.coalesce(F.col(id_col) % 97 == 13, F.lit(False))).withColumn(html_col, changed)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages")
    scratch = Scratch(spark, "merkle")
    index = scratch.write(archive(pages, "page_id", "url", "html"), "index")
    # The second copy is written as bytes and read back; then it is hashed whole.
    copy = scratch.write(damaged(pages, "page_id", "html"), "copy")
    replica = scratch.write(placed(archive(copy, "page_id", "url", "html"), index), "replica")
    levels = height(index, replica)
    return audit(tree(index, scratch, "a", levels), tree(replica, scratch, "b", levels), scratch)


ORACLE = f"""
WITH r AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
      || chr(13) || chr(10) || 'Content-Length: ' AS a, coalesce(html, '') AS body, chr(13) || chr(10) || chr(13) || chr(10) AS e
  FROM pages),
d AS (SELECT page_id, md5(page_id::VARCHAR) AS h, strlen(a || strlen(body) || e || body || e)::BIGINT AS length, sha256(a || strlen(body) || e || body || e) AS digest_a,
    sha256(a || strlen('?' || substr(body, 2)) || e || '?' || substr(body, 2) || e) AS changed FROM r),
o AS (SELECT *, (sum(length) OVER (ORDER BY h, page_id, digest_a) - length)::BIGINT AS "offset" FROM d)
SELECT ("offset" // {FILE_BYTES})::BIGINT AS file, "offset", length, page_id AS record_id, CASE WHEN page_id % 97 = 13 THEN 'missing' ELSE 'corrupt' END AS status, digest_a,
  CASE WHEN page_id % 97 = 13 THEN NULL ELSE changed END AS digest_b
FROM o WHERE page_id % 97 = 13 OR page_id % 41 = 7
"""
