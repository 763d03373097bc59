"""From documents to training sequences, in five stages. Each takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import decontam, langid, ngramjoin, packing, suffixdedup
from melisma.llm.store import Scratch, tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language and those whose score the calibration rejects."""
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2), "doc_id", "text", "lang")
    return langid.identify(docs, model, "text").filter(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the chosen-path join: the one with the least id."""
    return ngramjoin.one_of_each_class(docs, ngramjoin.similar_classes(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings that a document with a smaller id has. Where a cut divides a character, what is left of it goes too."""
    found = suffixdedup.remove_repeats(docs, as_text=True)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("row")["n_chars"])
    return found.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.find_contamination(docs, tables(spark, sf_dir, "benchmark")).filter(F.size("spans") == 0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row a piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packed),
]

#: Models and sketches can't be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = tables(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
