"""Lexical retrieval over a catalogue and its recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import ratio
from ledgerlight.operators import inverted
from ledgerlight.operators.scale import broadcast_if_small
from ledgerlight.session import durable
from ledgerlight.sources.writers import scratch_folder

ALL_TABLES = "*"
GATE = 0.95


def lexical_topk(
    questions: DataFrame, catalogue: DataFrame, k: int = 8, candidates: DataFrame | None = None,
    files: int | None = None, probes: int = inverted.PROBES,
) -> DataFrame:
    """Best ``k`` entries per question by weighted token overlap, from an index built for this call.

    questions: question_id, text. catalogue: entry, position, name, description, columns.
    ``candidates`` (entry) restricts the catalogue before ranking, so an entry that may
    not be used never displaces one that may. Ties keep catalogue order. For several calls
    on one catalogue, build the index once and use ``inverted.search``.
    """
    index = inverted.build(catalogue, scratch_folder(catalogue.sparkSession, "index"), files=files)
    return inverted.search(index, questions, k, candidates, probes)


def fk_expand(hits: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Hits plus their neighbours one link away, in both directions.

    hits: question_id, entry. edges: entry, reference. ``within`` (entry), the catalogue or
    what of it may be used, drops every other name. Few hits are broadcast, so links and names
    stay where they are read.
    """
    base = broadcast_if_small(hits.select("question_id", "entry").distinct())
    forward = edges.join(base, "entry").select("question_id", F.col("reference").alias("entry"))
    back = edges.select("reference", F.col("entry").alias("_from")).join(base, F.col("reference") == base.entry).select(
        "question_id", F.col("_from").alias("entry")
    )
    out = base.unionByName(forward).unionByName(back).distinct()
    if within is None:
        return out
    return within.select("entry").join(broadcast_if_small(out), "entry").select("question_id", "entry").distinct()


def full_cover_recall(gold: DataFrame, got: DataFrame) -> DataFrame:
    """Share of questions whose context holds all gold entries; questions without gold are skipped.

    gold and got: question_id, entry, one row per pair.
    """
    return cover(gold, got).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_missing") == 0).alias("full_hits"),
        ratio(F.count_if(F.col("n_missing") == 0), F.count(F.lit(1))).alias("recall"),
        ratio(F.sum("n_context"), F.count(F.lit(1))).alias("mean_context"),
    )


def cover(gold: DataFrame, got: DataFrame) -> DataFrame:
    """Gold entries, missing ones and context size per question that has gold."""
    marks = gold.select("question_id", "entry", F.lit(1).alias("g"), F.lit(0).alias("c")).unionByName(
        got.select("question_id", "entry", F.lit(0).alias("g"), F.lit(1).alias("c"))
    )
    pairs = marks.groupBy("question_id", "entry").agg(F.max("g").alias("g"), F.max("c").alias("c"))
    return pairs.groupBy("question_id").agg(
        F.sum("g").cast("long").alias("n_gold"),
        F.count_if((F.col("g") == 1) & (F.col("c") == 0)).alias("n_missing"),
        F.sum("c").cast("long").alias("n_context"),
    ).where("n_gold > 0")


def missing(gold: DataFrame, got: DataFrame) -> DataFrame:
    return gold.join(got.select("question_id", "entry"), ["question_id", "entry"], "left_anti")


def miss_causes(gold: DataFrame, got: DataFrame, catalogue: DataFrame, permitted: DataFrame) -> DataFrame:
    """Missing gold entries by cause: not permitted, letter case, or the ranking itself.

    All frames hold ``entry`` as text; gold and got also question_id. Of the names only those that
    are asked for leave the scan, while these are few.
    """
    rows = durable(missing(gold, got).withColumn("_low", F.lower("entry")))
    names = broadcast_if_small(rows.select("entry").distinct())
    lows = broadcast_if_small(rows.select("_low").distinct())
    known = catalogue.select("entry").join(names, "entry", "left_semi").distinct().withColumn("_known", F.lit(True))
    lowered = catalogue.select(F.lower("entry").alias("_low")).join(lows, "_low", "left_semi").distinct().withColumn("_folded", F.lit(True))
    allowed = permitted.select("entry").join(names, "entry", "left_semi").distinct().withColumn("_allowed", F.lit(True))
    rows = rows.join(known, "entry", "left").join(lowered, "_low", "left").join(allowed, "entry", "left")
    cause = (
        F.when(F.col("_known") & F.col("_allowed").isNull(), "not_permitted")
        .when(F.col("_known").isNull() & F.col("_folded"), "case_mismatch")
        .otherwise("other")
    )
    return rows.select("question_id", "entry", cause.alias("cause"))


def grant_scope(users: DataFrame, grants: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Scope and number of usable tables per user.

    users: user_id. grants: user_id, entry. ``*`` opens the whole catalogue, names
    outside it are ignored, and a user without a grant sees nothing.
    """
    size = catalogue.select("entry").distinct().agg(F.count(F.lit(1))).scalar()
    known = catalogue.select("entry").distinct().withColumn("_known", F.lit(True))
    per = (
        grants.select("user_id", "entry").distinct().join(known, "entry", "left")
        .groupBy("user_id")
        .agg(F.bool_or(F.col("entry") == ALL_TABLES).alias("_all"), F.count("_known").alias("_listed"))
    )
    joined = users.select("user_id").distinct().join(per, "user_id", "left")
    everything = F.coalesce(F.col("_all"), F.lit(False))
    n = F.when(everything, size).otherwise(F.coalesce(F.col("_listed"), F.lit(0)))
    return joined.select(
        "user_id", F.when(everything, "all").when(n > 0, "listed").otherwise("none").alias("scope"), n.alias("n_tables")
    )


def permitted(requests: DataFrame, grants: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests (user_id, entry) that the grants allow, each as a join on its keys."""
    real = requests.join(catalogue.select("entry"), "entry", "left_semi")
    stars = grants.where(F.col("entry") == ALL_TABLES).select("user_id").distinct()
    open_ = real.join(broadcast_if_small(stars), "user_id", "left_semi")
    closed = real.join(stars, "user_id", "left_anti").join(grants.select("user_id", "entry"), ["user_id", "entry"], "left_semi")
    return open_.unionByName(closed)
