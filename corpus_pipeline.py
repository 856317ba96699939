"""The corpus pipeline: low quality, near copies and benchmark text out, personal data replaced, then packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, also columns of other names. No stage crashes on null or empty texts,
null ids, repeated rows or an empty table, which stays empty; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import jaccard_join, packing, pseudonyms, quality_svm, queries, suffix_shards
from ledgerlight.llm.common import fresh, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the naive Bayes support vectors score at 0.5 or more.

    Null and empty texts have the score of the bias and stay or go together; equal texts have
    equal scores. Without labels of both classes all texts score alike.
    """
    model = quality_svm.fit(queries.labelled(docs, table(spark, sf_dir, "labels")))
    name = fresh(docs.columns, "score")
    return quality_svm.scores(docs, model, name=name).where(F.col(name) >= 0.5).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Null and empty texts and rows without id stay; of rows with one id one stays.
    """
    return jaccard_join.one_of_each(docs, stored(jaccard_join.jaccard_components(docs)))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold none and stay, repeated rows stay or go together; an empty
    benchmark drops nothing.
    """
    return suffix_shards.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data and secrets; n_chars follows the text.

    Every row stays. A null text stays null with a null n_chars; equal values get equal pseudonyms.
    """
    done = pseudonyms.pseudonymise(docs, queries.SAMPLE_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; a null text counts as empty, its piece is the end id."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("PII", private),
    ("packing", packed),
]

# Hashing, hinge-loss descent, keyed permutations and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
