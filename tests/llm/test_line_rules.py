import re

import duckdb
from pyspark.sql import functions as F

from melisma.llm import line_rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in wins if wins.count(x) > 1}
    at = {i + k for i, x in enumerate(wins) if x in twice for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def test_base_counts_and_edges(spark):
    prose = "A plain sentence of words that goes on, as sentences do."
    docs = [
        (1, None), (2, ""), (3, " \n\t\x0b "), (4, "a b c a b c"), (5, "a a a a"), (6, "x\nx\n y\n y\nx\n\n"), (7, (prose + "\n") * 3), (7, (prose + "\n") * 3), (8, "é ü # $ |"), (9, " ".join(f"w{k}" for k in range(60)) + "."),
        (10, "one two three " * 4000), (None, "null id"), (11, "\n".join(f"{w} | home{w} | about{w} | news{w} | shop{w} | more{w}" for w in range(20))), (12, "\n".join(" ".join(f"W{i}{j}" for j in range(12)).upper() for i in range(8))),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines", F.lit(1)).withColumn("t", F.lit("x"))
    rows = R.clean_lines(df, "doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(d), *base(t)) for d, t in docs)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[9] and not kept[11] and not kept[12] and not kept[1]
    assert R.clean_lines(df.limit(0), "doc_id", "text").count() == 0


def test_failing_lines_go_and_clean_ones_stay(spark):
    body = "\n".join(f"Sentence {k} says a{k} thing{k} of{k} its{k} own{k}, and{k} then{k} it{k} ends{k}." for k in range(12))
    df = spark.createDataFrame([(1, "Home | News | Shop | About\n" + body + "\nCookie settings apply here.")], "doc_id long, text string")
    r = R.clean_lines(df, "doc_id", "text").first()
    assert r.kept and r.clean_text == body


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = R.op10_line_first_rules(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(R.ORACLE).fetchall())
