"""Readers and writers: packed vectors, JSON lines, playlists as CSV, vector shards, manifests."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Fixed value: the packed vector file's header: magic, version, rows, dimension, spaces, quantisation, padded to 32 bytes.
MAGIC, HEADER = b"PAIVEC1\0", "<8s5I4x"
SHARD_ROWS = 16_384


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(row, audio, track) of packed int8 vector files: little-endian header, then row after row of two spaces. A wrong magic, version or length is an error."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                raw = memoryview(blob.as_buffer())
                magic, version, n, d, spaces, quant = struct.unpack_from(HEADER, raw)
                if magic != MAGIC or version != 1 or spaces != 2 or quant != 1 or len(raw) != 32 + n * d * spaces:
                    raise ValueError("not a packed vector file, or its length doesn't fit its header")
                data = np.frombuffer(raw, np.int8, offset=32).reshape(n, 2, d)
                for a in range(0, n, 10_000):
                    x = data[a : a + 10_000].astype(np.float32) / 127
                    to = lambda y: pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(y).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(x))), to(x[:, 0]), to(x[:, 1])], names=["row", "audio", "track"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parts, "row long, audio array<float>, track array<float>")


def pack_vectors(rows: list[tuple[list[float], list[float]]]) -> bytes:
    """A packed file's bytes, for a bounded number of rows."""
    x = np.array(rows, np.float64)
    n = np.linalg.norm(x, axis=2, keepdims=True)
    x = np.divide(x, n, out=x, where=n > 0)
    return struct.pack(HEADER, MAGIC, 1, len(x), x.shape[2], 2, 1) + np.rint(x * 127).astype(np.int8).tobytes()


def write_catalog(tracks: DataFrame, path: str) -> None:
    """The catalogue as Parquet, with search columns, unit vectors, and their signed bytes."""
    out = tracks.withColumns({"search": T.latin_search(F.concat_ws(" ", "artist", "title")), "artist_search": T.latin_search(F.col("artist")), "title_search": T.latin_search(F.col("title")), "unicode_search": T.unicode_search(F.concat_ws(" ", "artist", "title"))})
    for c in ("audio", "track"):
        if c in tracks.columns:
            out = out.withColumn(c, V.unit(F.col(c))).withColumn(f"{c}_i8", V.quantised(F.col(c)))
    out.write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """JSON lines by a fixed schema, and the rejected lines: those that don't parse or are too long."""
    raw = spark.read.text(path).select("value", F.octet_length("value").alias("bytes"))
    parsed = raw.withColumn("row", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("row._corrupt_record").isNotNull() | F.col("row").isNull() | (F.col("bytes") > most_bytes)
    return parsed.filter(~bad).select("row.*").drop("_corrupt_record"), parsed.filter(bad).select("value", "bytes")


def export_columns(df: DataFrame) -> DataFrame:
    return df.select("title", F.array_join("artists", ", ").alias("artist"), "album", "isrc", F.floor(F.col("duration_ms") / 1000).cast("long").alias("duration"))


def write_playlist(df: DataFrame, path: str) -> None:
    """CSV files with a header: title, artist, album, isrc, duration in seconds."""
    export_columns(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def safe_name(name: str) -> str:
    """A file name from a title."""
    kept = "".join(c if c.isalnum() or c in " -_." else "_" for c in name).strip(" .")
    return kept[:120] or "playlist"


def write_index(vectors: DataFrame, path: str) -> str:
    """Immutable unit vectors in id order, in shards of about SHARD_ROWS rows; the generation is a hash of the content that no partitioning changes."""
    n, bad, h = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.abs(V.norm(F.col("vector")) - 1) > 0.001, 1)), F.bit_xor(F.xxhash64("id", "vector"))).first()
    if bad:
        raise ValueError(f"{bad} vectors aren't of length 1")
    generation = f"{n:x}-{(h or 0) & (1 << 64) - 1:016x}"
    shards = max(1, -(-n // SHARD_ROWS))
    vectors.repartitionByRange(shards, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/{generation}")
    return generation


def write_postings(df: DataFrame, key: str, path: str, *texts: str) -> None:
    from ..operators.catalog import postings

    postings(df, key, *texts).repartition("term").sortWithinPartitions("term", key).write.mode("overwrite").parquet(path)


def write_manifest(files: DataFrame, jobs: DataFrame, path: str) -> None:
    """One JSON line a file with its jobs nested in order; the last column is the line's hash."""
    nested = jobs.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("kind", "state"))).alias("jobs"))
    rows = files.join(nested, "file_id", "left")
    rows.withColumn("sha256", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).write.mode("overwrite").json(path)


def publish(spark: SparkSession, root: str, generation: str) -> None:
    """Makes a generation the current one by writing a pointer table; readers that have resolved the old one keep it."""
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.schema('generation string').json(f'{root}/current').first()[0]}")
