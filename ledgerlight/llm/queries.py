"""Named queries ``opN_<name>`` of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import (
    balanced_search,
    bloom_lm,
    crf_extract,
    isolation_rules,
    jaccard_join,
    oracles,
    packing,
    periodic_runs,
    pseudonyms,
    quality_svm,
    reply_trees,
    spherical_cells,
    suffix_shards,
    warc_merge,
)
from ledgerlight.llm.common import fold, stored, table
from ledgerlight.operators import scale

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
# Only for tests and checks; a real run passes its own secret.
SAMPLE_KEY = b"sample key of the registered query"
BROADCAST_LABELS = 1_000_000  # rows of 12 bytes


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Texts of the training folds with their label; a small label table is broadcast after a count."""
    own = (
        labels.where(f"{label} in (0, 1)")
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(fold(F.col("_id"), 3) != 1)
        .distinct()
    )
    side = F.broadcast(own) if own.count() <= BROADCAST_LABELS else own
    return docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("_id")).select("text", F.col("y").alias("quality"))


@query
def op1_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_svm.fit(labelled(docs, table(spark, sf_dir, "labels")))
    scored = quality_svm.scores(docs, model)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn answers the one before it, so each conversation is a tree with one branch."""
    sample = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    turns = stored(turns.unionByName(spark.createDataFrame(sample, turns.schema)))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    numbered = stored(scale.numbered(turns.select("*", F.lit(None).cast("double").alias("score")), order, "node", ["conv_id"]))
    answers = F.when(F.col("node") > 1, F.col("node") - 1).alias("parent")
    segments = reply_trees.format_trees(numbered.select(F.col("conv_id").alias("tree"), "node", answers, "role", "text", "score"))
    return reply_trees.read_back(segments).withColumnRenamed("tree", "conv_id").drop("leaf")


@query
def op3_window_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), SAMPLE_KEY)


@query
def op5_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = isolation_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *isolation_rules.COUNTS, "base_failed", "kept")


@query
def op6_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_shards.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query
def op8_crf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return crf_extract.extract(pages, crf_extract.fit()).withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_loser_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages hold no time of capture: one second a page
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", when.alias("captured"))
    index = warc_merge.capture_history(pages, warc_merge.archive_folder(spark))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_bloom_filter_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 7) == 2
    scored = bloom_lm.score(table(spark, sf_dir, "documents"), ~held)
    return scored.withColumn("held_out", held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op11_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_cells.cosine_groups(table(spark, sf_dir, "embeddings"))


@query
def op12_balanced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_search.cluster(table(spark, sf_dir, "embeddings"))


def tenth_made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by hash, repeat a stretch of their words up to the end."""
    if doc_id is None or not words:
        return words
    tens, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    n = len(words)
    a = tens % n
    period = 1 + (n - a) // (3 + tens % 8)
    unit = words[a : a + period]
    return words[:a] + (unit * ((n - a) // period + 1))[: n - a]


@query
def op13_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=tenth_made_periodic)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", longest.alias("top"), lines.alias("lines"), "collapsed").select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"), F.expr("1000 * top.n div -top.p").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SQL.update({
    "op2_reply_trees": oracles.REPLY_TREES,
    "op6_adaptive_jaccard": oracles.JACCARD,
    "op7_suffix_arrays": oracles.SUFFIXES,
    "op9_loser_tree_merge": oracles.ARCHIVES,
    "op11_spherical_cells": oracles.COSINES,
    "op12_balanced_search": oracles.CENTROIDS,
})
