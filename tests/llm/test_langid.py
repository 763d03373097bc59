import math
import random
import zlib

from pyspark.sql import functions as F

from melisma.llm import langid

WORDS = {"en": "the and of with that from this house water they", "de": "der die und nicht mit schön über straße wasser sie", "fr": "le la les été où avec maison eau très être"}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(8, 60))), lang) for k in range(n) for lang in [list(WORDS)[k % 3]]]


def test_edges(spark):
    df = spark.createDataFrame(texts(300), "doc_id long, text string, lang string")
    model = langid.train(df, "doc_id", "text", "lang")
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 %% 4", 1), (4, "日本語", 1), (5, "the house and the water " * 3000, 1), (5, "der die und nicht", 1), (5, "der die und nicht", 1)], "doc_id long, text string, g int")
    rows = langid.identify(odd, model, "text").orderBy("row.doc_id", F.length("row.text")).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(r.score == 0 and r.rejected for r in rows[:3])
    assert rows[3].lang_pred in WORDS and [r.lang_pred for r in rows[4:]] == ["de", "de", "en"] and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(odd.limit(0), model, "text").count() == 0
    assert langid.train(df.limit(0), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in langid.identify(odd, None, "text").collect()} == {"und"}


def test_chunks_and_batches_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(texts(120), "doc_id long, text string, lang string")
    model = langid.train(df, "doc_id", "text", "lang")
    one = {r.row.doc_id: r.score for r in langid.identify(df.coalesce(1), model, "text").collect()}
    many = {r.row.doc_id: r.score for r in langid.identify(df.repartition(7), model, "text").collect()}
    assert max(abs(one[k] - many[k]) for k in one) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op5_subword_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    n, right, rejected = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 150 and right >= 0.98 * n and rejected <= 0.02 * n


def plainly(model, text):
    """(language, score) of a text, a run of bytes at a time."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    total, n = model.bias * 0.0, 0
    padded = b" " + raw + b" "
    for k in langid.ORDERS:
        for i in range(len(padded) - k + 1):
            code = 0x9E37 * k
            for b in padded[i : i + k]:
                code = ((code ^ b) * 0x01000193) & 0xFFFFFFFF
            total = total + model.table[((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)].astype(float)
            n += 1
    z = [v / model.temperature for v in (total / max(n, 1) + model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    top = max(range(len(e)), key=lambda i: e[i])
    return model.classes[top], e[top] / sum(e)


def test_query_equals_a_plain_reading(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2), "doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = langid.op5_subword_language(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, score = plainly(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4
