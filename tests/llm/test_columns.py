"""Columns of the input that are called like an operator's own, ids of other types, missing and repeated ids, empty tables and very long texts."""

import pytest
from pyspark.sql import functions as F
from test_ngramjoin import brute as near
from test_suffixdedup import brute as repeats

from melisma.llm import decontam, htmlwrap, langid, line_rules, merkle, ngramjoin, packing, quality_knn, sharding, suffixdedup

LINE = "This line of more than fifty bytes is said in a number of places. "
TEXTS = [LINE * 2, LINE + "and a tail of its own", None, "", "the house and the water with that from this they of and the house", LINE * 2, "der die und nicht mit der schön über straße wasser sie der die", "x"]
#: Names that operators use for what they add or for themselves.
NAMES = "row score rejected lang_pred predicted spans items n_words kept n_bytes n_removed n_spans to kind blob doc own at bytes _at h id rep vid c1 c2 n tokens sketch node class_id n_links chosen text_hash bin size members ids shard slot law first copies _host _html _seed clean_text w lines t label digest length offset record_id segment".split()


def table(spark, rows, kind="long", text="text", **columns):
    df = spark.createDataFrame(rows, f"doc_id {kind}, {text} string")
    for k, c in enumerate(n for n in [*NAMES, "a.b", "c d", "e`f"] if n not in columns):
        df = df.withColumn(c, F.lit(k))
    for c, v in columns.items():
        df = df.withColumn(c, v)
    return df


def documents(spark):
    return table(spark, list(enumerate(TEXTS)), lang=F.when(F.col("doc_id") < 6, "en").otherwise("de"), source=F.lit("s"), n_chars=F.char_length("text").cast("long"))


def test_every_stage_keeps_its_columns(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "of and the house " * 4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r["rejected"] for r in out.collect()} == {NAMES.index("rejected")}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    rows = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(len(TEXTS)))


def test_operators_beside_the_pipeline(spark):
    docs = documents(spark)
    labels = table(spark, [(k, "x") for k in range(6)], quality=F.col("doc_id") % 2)
    model = quality_knn.train(docs, labels, "doc_id", "text", "quality")
    assert quality_knn.classify(docs, model, "text").count() == len(TEXTS)
    assert sharding.shard(docs, "doc_id", "text").count() == len(TEXTS)
    assert line_rules.clean_lines(docs, "doc_id", "text").count() == len(TEXTS)
    pages = table(spark, [(k, f"<p>{t}") for k, t in enumerate(TEXTS)], text="html", url=F.lit("http://h/x")).withColumnRenamed("doc_id", "page_id")
    assert htmlwrap.main_text(pages, "page_id", "url", "html").count() == len(TEXTS)
    assert merkle.archive(pages, "page_id", "url", "html").count() == len(TEXTS)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, kind):
    rows = [(str(k) if kind == "string" else k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngramjoin.similar_classes(df).collect()) == near(rows)
    assert {r.doc_id for r in packing.pack(df).collect()} == {r[0] for r in rows}
    assert sharding.shard(df, "doc_id", "text").count() == len(rows)
    assert decontam.find_contamination(df, spark.createDataFrame([("a", "x")], "item_id string, text string")).filter("size(spans) > 0").count() == 1
    got = suffixdedup.remove_repeats(df).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == repeats([(k, t) for k, t in enumerate(TEXTS)])


def test_no_ids_and_one_id(spark):
    for key in (None, 7):
        rows = [(key, t) for t in TEXTS]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngramjoin.similar_classes(df).collect()) == near(rows)
        got = suffixdedup.remove_repeats(df).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == repeats(rows)
        assert packing.pack(df).count() == len(rows) and sharding.shard(df, "doc_id", "text").count() == len(rows)


def test_very_long_texts(spark):
    """A text of 10 MB, and a word of 3 MB, beside their copies."""
    rows = [(1, "the house and the water of that " * 300_000), (2, "x" * 3_000_000 + " the house"), (3, "the house and the water of that " * 300_000 + "end"), (4, "X" * 3_000_000 + " the house"), (5, "short")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    classes = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.similar_classes(df).collect()}
    assert classes[1] == classes[3] == (1, 1)
    assert classes[2] == classes[4] == (2, 1) and classes[5] == (5, 0)
    sample = spark.createDataFrame([(k, "the house and the water", "en") if k % 2 else (k, "der die und nicht mit", "de") for k in range(80)], "doc_id long, text string, lang string")
    model = langid.train(sample, "doc_id", "text", "lang")
    assert {r.row.doc_id: r.lang_pred for r in langid.identify(df, model, "text").collect()}[1] == "en"
    items = spark.createDataFrame([(1, "the water of that the house and the water of")], "item_id long, text string")
    marked = {r.row.doc_id: r for r in decontam.find_contamination(df, items).collect()}
    assert marked[1].n_words == 2_100_000 and len(marked[1].spans) == 1 and not marked[2].spans
    removed = {r.row.doc_id: (r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(df).select("row", "n_bytes", "n_removed").collect()}
    assert removed[1] == (9_600_000, 0) and removed[3] == (9_600_003, 9_600_000) and removed[4][1] == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    assert quality_knn.classify(df, quality_knn.train(sample, labels, "doc_id", "text", "quality"), "text").count() == 5
