import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.llm import suffixdedup as S


def brute(docs, length=50):
    first = {}
    raw = [((d is not None, d), (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w not in first or d < first[w]:
                first[w] = d
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(d[1]), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.h) for r in df.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect())


def some(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(8)]
    docs = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        text = " ".join(parts)
        if docs and rng.random() < 0.2:
            text = rng.choice(docs)[1]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "x", " new words "]) + text[at:]
        docs.append((rng.randrange(-20, 1000), text))
    return docs


def test_edges(spark):
    line = "This line of more than fifty bytes is said in a number of places. "
    docs = [
        (3, line * 3), (1, line), (2, "x" + line + "y"), (2, "x" + line + "y"), (4, None), (5, ""), (6, "short"), (7, line[:49]), (8, line[:50]), (9, "a" * 5000), (10, "a" * 300 + "b" * 70),
        (11, "é" * 60), (12, "e" + "é" * 60), (None, line), (13, "Pre " + line[5:60] + line[3:64]),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit(7)).withColumn("blob", F.lit("b"))
    out = S.remove_repeats(df)
    assert got(out) == brute(docs)
    assert {(r.row.kind, r.row.blob) for r in out.collect()} == {(7, "b")}
    assert S.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    docs = some(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(S.remove_repeats(df)) == brute(docs)


def test_hot_anchors_and_long_texts(monkeypatch):
    """The steps run by hand, with limits so low that every path is taken."""
    import pyarrow as pa

    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "SEGMENT", 700)
    docs = [(d, t * (1 + 5 * (d % 7 == 0))) for d, t in some(3, 40)] + [(5000 + k, f"{k:05d}" * 9 + "the passage that all of these documents share, which is long enough " + f"{k * 7:05d}" * 9) for k in range(40)]
    n_buckets = n_homes = 4
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs[a : a + 16]], pa.int64()), pa.array([t for _, t in docs[a : a + 16]])], names=["doc", "text"]) for a in range(0, len(docs), 16)]

    def shuffled(parts, *keys):
        rows = [r for b in parts for r in b.to_pylist()]
        rows.sort(key=lambda r: tuple(r[k] for k in keys))
        schema = parts[0].schema
        return [pa.RecordBatch.from_pylist(rows[a : a + 7], schema=schema) for a in range(0, len(rows), 7)]

    def joined(replies, kind):
        schema = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("text", pa.string())])
        rows = [r | {"doc": None, "text": None} for b in replies for r in b.to_pylist() if r["kind"] == kind]
        rows += [{"to": int(S.home(np.array([d]), n_homes)[0]), "kind": S.TEXT, "blob": None, "doc": d, "text": t} for d, t in docs]
        rows.sort(key=lambda r: (r["to"], r["kind"]))
        return [pa.RecordBatch.from_pylist(rows[a : a + 9], schema=schema) for a in range(0, len(rows), 9)]

    replies = list(S.settle_pieces(iter(shuffled(list(S.find_pieces(iter(batches), n_buckets, n_homes, 50)), "to")), n_homes))
    fetched = list(S.fetch(iter(joined(replies, S.ASK)), n_buckets, 50))
    rows = [r for b in fetched for r in b.to_pylist()]
    assert any(r["bytes"] is None for r in rows) and any(r["at"] for r in rows)
    partial = list(S.sort_suffixes(iter(shuffled(fetched, "to")), n_homes, 50))
    out = [r for b in S.apply(iter(joined(replies + partial, S.FULL)), 50) for r in b.to_pylist()]
    assert sorted((str(r["doc"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out) == brute(docs)


def test_suffix_order_is_the_order_of_bytes():
    rng = np.random.default_rng(5)
    data = np.frombuffer(b"".join(rng.choice([b"abab", b"aaaa", b"xyz", b"the common passage "]) for _ in range(400)), np.uint8)
    starts = np.arange(len(data) - 50)
    order = S.suffix_order(S.Text(data, 50), starts)
    raw = data.tobytes()
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in starts)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((str(r[0]), *tuple(r)[1:]) for r in S.op4_suffix_dedup(spark, sf).collect())
    assert rows == brute(docs) and any(r[2] for r in rows)
