"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are hashed runs of 3 and 4 bytes of its lower-cased letters, anything else counting as a space. Their embeddings are
averaged and go through a linear softmax; both are trained by stochastic gradient descent in numpy on a bounded sample.
The model being linear in the average, embedding and output fold into one table of a row a bucket, which scores texts of any length.
A temperature and the least score to accept are fitted on rows of the sample that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import kernels as K
from .store import short_batches, tables, whole

#: Rows a language in the training sample, and rows in all, in expectation (a row is 16 KB); and how many languages, the most frequent ones, a model knows.
SAMPLE_ROWS, TOTAL_ROWS, MOST_LANGUAGES = 500, 8000, 1000
BUCKET_BITS, DIMENSIONS, ORDERS, EPOCHS, RATE, BATCH = 12, 16, (3, 4), 30, 1.0, 32
#: Of the calibration rows that are predicted right, the part that rejection may cost; and the margin put below that score.
REJECT_RIGHT, MARGIN = 0.001, 0.8
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def buckets(wide: np.ndarray, k: int, n: int) -> np.ndarray:
    """Buckets of the runs of k bytes at the first n places."""
    code = np.full(n, 0x9E37 * k, np.uint32)
    for j in range(k):
        code = (code ^ wide[j : n + j]) * np.uint32(0x01000193)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def counted(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in one text, a chunk at a time."""
    text = np.full(len(data) + 2, 32, np.uint8)
    text[1:-1] = _LETTER[data]
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for lo in range(0, len(text), K.CHUNK):
        wide = text[lo : lo + K.CHUNK + max(ORDERS) - 1].astype(np.uint32)
        for k in ORDERS:
            out += np.bincount(buckets(wide, k, min(K.CHUNK, len(wide) - k + 1)), minlength=len(out)) if len(wide) >= k else 0
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte runs of a block, one row of the result an order, and where each text's begin. Each text stands between spaces; a run that would leave its text has the bucket 2**BUCKET_BITS."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    at = offsets + 2 * np.arange(n + 1)
    text = np.full(at[-1] + 4, 32, np.uint8)
    text[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), sizes)] = _LETTER[data]
    wide = text.astype(np.uint32)
    out = np.empty((len(ORDERS), at[-1]), np.int64)
    for i, k in enumerate(ORDERS):
        out[i] = buckets(wide, k, at[-1])
        for j in range(1, k):
            out[i, (at[1:] - j)] = 1 << BUCKET_BITS
    return out, at


@K.tidy
def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of sampled texts, scaled to a sum of 1."""
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        rows: list[bytes] = []
        for a, b in K.blocks(offsets, K.BLOCK):
            for r in range(a, b):
                c = counted(data[offsets[r] : offsets[r + 1]]).astype(np.float32)
                rows.append((c / max(c.sum(), 1)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "bag"])


@dataclass
class Model:
    table: np.ndarray  # a row of class scores for each bucket, and one of zeros
    bias: np.ndarray
    classes: list[str]
    temperature: float
    least: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    classes = sorted(set(langs))
    y = np.array([classes.index(v) for v in langs])
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order[:0]
    train = order[len(held) :]
    e = rng.normal(0, 0.1, (x.shape[1], DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(classes)), np.float32)
    b = np.zeros(len(classes), np.float32)
    boost = np.float32(20)  # averages over thousands of features are small
    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for a in range(0, len(train), BATCH):
            i = train[a : a + BATCH]
            h = boost * (x[i] @ e)
            g = softmax(h @ w + b)
            g[np.arange(len(i)), y[i]] -= 1
            g *= RATE * (1 - done / steps) / len(i)
            gh = boost * (g @ w.T)
            w -= h.T @ g
            b -= g.sum(0)
            e -= x[i].T @ gh
            done += 1
    table = np.vstack([boost * (e @ w), np.zeros((1, len(classes)), np.float32)]).astype(np.float32)
    model = Model(table, b, classes, 1.0, 0.0)
    if len(held):
        z = x[held] @ table[:-1] + b
        grid = np.geomspace(0.25, 4, 33)
        nll = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        model.least = float(np.quantile(right, REJECT_RIGHT) * MARGIN) if len(right) else 0.0
    return model


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the rows with a language and a text; None if there are none. Rows are sampled by a hash of their id, a language alike."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    each = min(sample_rows, TOTAL_ROWS // len(counts))
    share = F.create_map(*(F.lit(v) for lang, n in counts for v in (lang, min(1.0, each / n))))
    place = F.pmod(F.xxhash64(F.lit("langid"), id_col, F.octet_length(text_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = rows.filter(place < F.element_at(share, F.col(lang_col))).select(lang_col, text_col).mapInArrow(bags, "lang string, bag binary").collect()
    got = sorted((r for r in got if any(r.bag)), key=lambda r: (r.lang, bytes(r.bag)))
    if not got:
        return None
    return fit(np.stack([np.frombuffer(bytes(r.bag), np.float32) for r in got]), [r.lang for r in got])


@K.tidy
def score(batches: Iterator[pa.RecordBatch], model: Model | None, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(0).field(text))
        lang, best, known = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
        for a, b in K.blocks(offsets):
            own, at0 = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            plain = np.concatenate([[0], np.cumsum(((own >= 65) & (own <= 90)) | ((own >= 97) & (own <= 122)))])
            letters = plain[at0[1:]] > plain[at0[:-1]]
            for r in np.flatnonzero(~letters & (at0[1:] > at0[:-1])).tolist():  # digits, symbols or other scripts only
                letters[r] = any(map(str.isalpha, own[at0[r] : at0[r + 1]].tobytes().decode("utf-8", "replace")))
            known[a:b] = letters
            if model is None:
                lang += [UNKNOWN] * (b - a)
                continue
            if len(own) > K.CHUNK:  # one long text
                total, at = counted(own)[None] @ model.table[:-1], at0 + 2 * np.arange(len(at0))
            else:
                g, at = grams(own, at0)
                total = np.add.reduceat(model.table[g[0]] + model.table[g[1]], at[:-1], axis=0)
            n = np.maximum(1, len(ORDERS) * np.diff(at) - sum(k - 1 for k in ORDERS))
            p = softmax((total / n[:, None] + model.bias) / model.temperature)
            top = p.argmax(1)
            best[a:b] = np.where(letters, p[np.arange(b - a), top], 0.0)
            lang += [model.classes[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), letters.tolist(), strict=True)]
        rejected = ~known | (best < (model.least if model else np.inf))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(best), pa.array(rejected)], names=["row", "lang_pred", "score", "rejected"])


def identify(df: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """row (a row of df, whole), lang_pred, score and rejected.

    A null text or one without letters is `und`, scores 0 and is rejected; so is everything without a model. A text whose score is under the
    calibrated least is rejected but keeps its prediction. Empty tables and repeated rows need no care.
    """
    short_batches(df.sparkSession)
    rows, sent, at = whole(df), df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return rows.mapInArrow(lambda x: score(x, sent.value, at), StructType([*rows.schema.fields, *added]))


def remainder(id_col: str, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op5_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = train(docs.filter(~held), "doc_id", "text", "lang")
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, "text").select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")
