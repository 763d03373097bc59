"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed words, hashed runs of its outline, in which letters, capitals, digits and spaces are one character each and
symbols stay, and whether words repeat the one before. Counts of a bounded sample of labelled texts are weighted by TF-IDF and decomposed; all texts are projected onto the
leading directions. Each one's cosines with every labelled vector are computed exactly, in blocks, and the nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import kernels as K
from .langid import remainder
from .store import short_batches, tables, whole

#: Labelled rows a class, in expectation: they bound what is fitted and what is broadcast (2 * SAMPLE_ROWS vectors of DIMENSIONS floats).
SAMPLE_ROWS = 1500
WORD_BITS, OUTLINE_BITS, DIMENSIONS, NEIGHBOURS, SHARPNESS, CUT = 11, 11, 48, 25, 8, 0.3

_OUTLINE = np.arange(256, dtype=np.uint8)
_OUTLINE[97:123] = _OUTLINE[128:] = 97
_OUTLINE[65:91] = 65
_OUTLINE[48:58] = 48
_OUTLINE[[9, 11, 12, 13]] = 32
#: The last two terms are words that repeat the word before them, and words that do not.
TERMS = (1 << WORD_BITS) + (1 << OUTLINE_BITS) + 2


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts, a row a text. Of a long text those of its parts are added, which are cut at white space where there is any near."""
    n = len(offsets) - 1
    if n == 1 and len(data) > K.CHUNK:
        out, lo = np.zeros((1, TERMS), np.float32), 0
        while lo < len(data):
            hi = min(len(data), lo + K.CHUNK // 2)
            space = np.flatnonzero(data[hi : hi + 4096] <= 32)
            hi += int(space[0]) if hi < len(data) and len(space) else 0
            out += counts(data[lo:hi], np.array([0, hi - lo]))
            lo = hi
        return out
    s, e, rows, _ = K.words(data, offsets)
    hashes = K.word_hashes(data, s, e)
    fresh = np.ones(len(s), np.int64)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    terms = [rows * TERMS + (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), rows * TERMS + TERMS - 2 + fresh]
    shape = _OUTLINE[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (row[1:] != row[:-1])  # runs count once
    shape, row = shape[keep].astype(np.uint32), row[keep]
    for k in (2, 3):
        if len(shape) >= k:
            code = np.full(len(shape) - k + 1, k, np.uint32)
            for j in range(k):
                code = (code ^ shape[j : len(shape) - k + 1 + j]) * np.uint32(0x01000193)
            same = row[: len(code)] == row[k - 1 :]
            bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - OUTLINE_BITS)
            terms.append(row[: len(code)][same] * TERMS + (1 << WORD_BITS) + bucket[same].astype(np.int64))
    return np.bincount(np.concatenate(terms), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


@K.tidy
def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        rows: list[bytes] = []
        for a, b in K.blocks(offsets, K.BLOCK):
            rows += [np.minimum(r, 60000).astype(np.uint16).tobytes() for r in counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "bag"])


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each kind of term counts alike: log counts times idf, scaled to length 1 by kind."""
    x = np.log1p(c) * idf
    for part in (x[:, : 1 << WORD_BITS], x[:, 1 << WORD_BITS : -2], x[:, -2:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def fit(c: np.ndarray, labels: np.ndarray, seed: int = 11) -> Model:
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1).astype(np.float32)
    x = weighted(c, idf)
    rng = np.random.Generator(np.random.PCG64(seed))
    q = rng.normal(size=(x.shape[1], min(DIMENSIONS + 10, len(c)))).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    directions = (q @ v.T)[:, :DIMENSIONS].astype(np.float32)
    return Model(idf, directions, unit(x @ directions).astype(np.float32), labels.astype(np.float32), float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the documents with a text and a label of 0 or 1; None if there are none. A class gives sample_rows labels in expectation, chosen by a hash of the id, and only these meet the documents."""
    labels = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("label") == 1, min(1.0, sample_rows / n.get(1, 1))).otherwise(min(1.0, sample_rows / n.get(0, 1)))
    chosen = labels.filter(place < share)
    # About 2 * sample_rows rows of two numbers, whatever the size of the tables.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    got = texts.join(F.broadcast(chosen), "id").select("label", "text").mapInArrow(sampled, "label int, bag binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.bag)))
    if not got:
        return None
    return fit(np.stack([np.frombuffer(bytes(r.bag), np.uint16) for r in got]).astype(np.float32), np.array([r.label for r in got]))


def vote(cosines: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest; where nothing is similar, the prior. Of vectors that are equally near at the last place the first ones vote."""
    k = min(NEIGHBOURS, cosines.shape[1])
    least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k:].min(1, keepdims=True)
    above, ties = cosines > least, cosines == least
    chosen = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True)))
    near = np.nonzero(chosen)[1].reshape(len(cosines), k)
    w = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
    return np.clip(((w * labels[near]).sum(1) + 1e-6 * prior) / (w.sum(1) + 1e-6), 0.0, 1.0)


@K.tidy
def rate(batches: Iterator[pa.RecordBatch], model: Model | None, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows)
        data, offsets = K.buffers(batch.column(0).field(text))
        if model is not None:
            for a, b in K.blocks(offsets, K.BLOCK):
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    x = weighted(counts(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]), model.idf)
                    out[c:d] = vote(unit(x @ model.directions) @ model.vectors.T, model.labels, model.prior)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= CUT).astype(np.int32))], names=["row", "score", "predicted"])


def classify(df: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """row (a row of df, whole), score and predicted.

    A null or empty text is similar to nothing and scores the sample's share of label 1. Without labelled rows every score is 0.
    """
    short_batches(df.sparkSession)
    rows, sent, at = whole(df), df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)
    return rows.mapInArrow(lambda x: rate(x, sent.value, at), StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op8_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 5) == 0
    labels = tables(spark, sf_dir, "labels").filter(~held).select("doc_id", "quality")
    model = train(docs, labels, "doc_id", "text", "quality")
    return classify(docs.select("doc_id", held.alias("held_out"), "text"), model, "text").select("row.doc_id", "row.held_out", "score", "predicted")
