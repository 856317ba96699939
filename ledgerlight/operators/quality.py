"""Profiling, key and rule audits, catalogue checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import ratio
from ledgerlight.operators.scale import join_null_safe, scalars

HUMAN = "human"
# Confidence levels a generated description may carry.
CONFIDENCE = ("high", "low")
# Kana, CJK (extension A and unified) and hangul ranges.
FOREIGN_SCRIPT = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7a3]"
# A merge that would drop more than this share of reviewed entries is refused.
SHRINK_LIMIT = 0.5


def profile_columns(df: DataFrame, table: str) -> DataFrame:
    """Row count, type, nulls and ends of every column from one aggregate over the table."""
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, T.NumericType)
        text = isinstance(f.dataType, T.StringType)
        aggs.append(F.count_if(c.isNull()).alias(f"_n{i}"))
        for end, fn in (("lo", F.min), ("hi", F.max)):
            if numeric or text:
                aggs.append(fn(c).alias(f"_{end}{i}"))
        none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
        rows.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col("_rows").alias("n_rows"),
            F.col(f"_n{i}").alias("n_nulls"),
            (F.col(f"_lo{i}").cast("double") if numeric else none_d).alias("min_number"),
            (F.col(f"_hi{i}").cast("double") if numeric else none_d).alias("max_number"),
            (F.col(f"_lo{i}") if text else none_s).alias("min_text"),
            (F.col(f"_hi{i}") if text else none_s).alias("max_text"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def enum_values(df: DataFrame, cols: Sequence[str], table: str, k: int = 12) -> DataFrame:
    """Values of the columns holding at most ``k`` distinct ones.

    An approximate count with wide slack keeps key-like columns out of the exact
    pass; the exact pass decides.
    """
    guess = scalars(df, **{c: F.approx_count_distinct(c) for c in cols})
    cells = F.array(*[
        F.when(F.col(f"_g.{c}") <= 4 * k + 20, F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
        for c in cols
    ])
    seen = (
        df.withColumn("_g", guess).select(F.inline(F.array_compact(cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        seen.groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_values"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("enum_values"))
        .where(F.col("n_values") <= k)
        .select(F.lit(table).alias("table_name"), "column_name", "n_values", "enum_values")
    )


def key_audit(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Rows, distinct keys, keys held more than once and rows with a null key part."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    broken = F.lit(False)
    for c in key:
        broken = broken | F.col(c).isNull()
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(broken, F.col("_n"))), F.lit(0)).alias("null_key_rows"),
    ).select(F.lit(name).alias("key_name"), "*")


def orphan_audit(child: DataFrame, column: str, parent: DataFrame, target: str, name: str) -> DataFrame:
    """Referencing rows and those without a parent; null references are no orphans.

    References are counted per value first, so a value shared by many rows is
    compared once.
    """
    refs = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(target).alias("_ref")).distinct().withColumn("_known", F.lit(True))
    return refs.join(known, "_ref", "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_refs"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(F.col("_known").isNull()).alias("orphan_values"),
    ).select(F.lit(name).alias("fk_name"), "*")


def rule_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule in one pass. As in SQL, a rule that is null is not violated."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(~c).alias(f"_r{i}") for i, c in enumerate(rules.values())])
    rows = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col("_rows").alias("n_rows"), F.col(f"_r{i}").alias("violations"))
        for i, n in enumerate(rules)
    ])
    return one.select(F.inline(rows))


def known_estimate(col: Column) -> Column:
    """Row estimate where -1 means never analysed."""
    return F.when(col >= 0, col)


def fk_targets(links: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Check that every declared link points at a unique column; keep the reason when not.

    links: child_table, child_column, parent_table, parent_column; columns: table_name,
    column_name; keys: table_name, column_name for single-column primary or unique keys.
    Names match without regard to case; a name that matches several columns is ambiguous.
    """
    low = columns.select(
        F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"), F.col("column_name").alias("_real")
    )
    found = low.groupBy("_t", "_c").agg(F.count(F.lit(1)).alias("_hits"), F.min("_real").alias("target_column"))
    unique = keys.select(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")).distinct().withColumn("_u", F.lit(True))
    tables = columns.select(F.lower("table_name").alias("_t")).distinct().withColumn("_known", F.lit(True))
    out = links.withColumns({"_t": F.lower("parent_table"), "_c": F.lower("parent_column")})
    out = out.join(tables, "_t", "left").join(found, ["_t", "_c"], "left").join(unique, ["_t", "_c"], "left")
    reason = (
        F.when(F.col("_known").isNull(), "no such table")
        .when(F.col("_hits").isNull(), "no such column")
        .when(F.col("_hits") > 1, "ambiguous column")
        .when(F.col("_u").isNull(), "target not unique")
    )
    return out.select(
        "child_table", "child_column", "parent_table", "parent_column", "target_column",
        reason.isNull().alias("kept"), reason.alias("reason"),
    )


def table_lines(columns: DataFrame, by: Sequence[str] = ("table_name",)) -> DataFrame:
    """Canonical text of a table: name, sorted columns, primary key, foreign keys.

    columns: table_name, column_name, data_type, is_generated, is_key, reference (null
    when the column is no foreign key). The width of a table bounds the arrays.
    """
    one = F.concat_ws(":", "column_name", "data_type", F.when(F.col("is_generated"), "True").otherwise("False"))
    link = F.when(F.col("reference").isNotNull(), F.concat_ws("->", "column_name", "reference"))

    def joined(col: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(col)), lambda s: s["v"]), ",")

    def keyed(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.col("column_name").alias("k"), value.alias("v")))

    cols, pk, fk = joined(keyed(one)), joined(keyed(F.when(F.col("is_key"), F.col("column_name")))), joined(keyed(link))
    return columns.groupBy(*by).agg(F.concat_ws("|", F.first("table_name"), cols, pk, fk).alias("line"))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


CHUNK = 1 << 20  # characters of neighbouring lines that travel as one value


def catalogue_fingerprint(columns: DataFrame, database: str) -> DataFrame:
    """Structural hash of each database, independent of row order.

    Lines are sorted over all tasks and joined to chunks of about CHUNK characters; the
    chunks of a database stream in order through one running hash, which has one order.
    """
    lines = table_lines(columns, (database, "table_name")).select(database, "table_name", "line")
    parts = T.StructType([lines.schema[database], lines.schema["table_name"], T.StructField("line", T.StringType())])
    done = T.StructType([lines.schema[database], T.StructField("fingerprint", T.StringType())])

    def batch(rows: list[tuple], like: pa.RecordBatch, names: Sequence[str]) -> pa.RecordBatch:
        types = [*[f.type for f in like.schema][: len(names) - 1], pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = None, [], 0
        for rows in batches:
            for key, name, line in zip(*(c.to_pylist() for c in rows.columns)):
                if held and (key != first[0] or size >= CHUNK):
                    yield batch([(*first, "\n".join(held))], rows, parts.names)
                    held, size = [], 0
                if not held:
                    first = key, name
                held.append(line)
                size += len(line)
        if held:
            yield batch([(*first, "\n".join(held))], rows, parts.names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for rows in batches:
            for own, _, text in zip(*(c.to_pylist() for c in rows.columns)):
                if state is not None and own == key:
                    state.update(b"\n")
                else:
                    if state is not None:
                        yield batch([(key, state.hexdigest()[:16])], rows, done.names)
                    key, state = own, hashlib.sha256()
                state.update(text.encode())
        if state is not None:
            yield batch([(key, state.hexdigest()[:16])], rows, done.names)

    order = (database, "table_name")
    chunks = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunked, parts)
    return chunks.repartition(database).sortWithinPartitions(*order).mapInArrow(hashed, done)


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two catalogues."""
    key = ["table_name", "column_name"]
    both = old.select(*key, F.col("data_type").alias("old_type")).join(
        new.select(*key, F.col("data_type").alias("new_type")), key, "full_outer"
    )
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def merge_entries(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge curated and newly generated descriptions.

    Entries: table_name, column_name (null for the table itself), text, reviewed_by.
    A reviewed existing entry wins. Otherwise the fresh one is taken. A table must be
    in the fresh set; a column must be fresh, or reviewed and in a fresh table.
    """
    key = ["table_name", "column_name"]
    old = existing.select(*key, F.struct("text", "reviewed_by").alias("_old"))
    new = fresh.select(*key, F.struct("text", "reviewed_by").alias("_new"))
    both = old.withColumn("_new", F.lit(None).cast(new.schema["_new"].dataType)).unionByName(
        new.withColumn("_old", F.lit(None).cast(old.schema["_old"].dataType))
    )
    # A null column name is a key value of its own: grouping keeps it, a join would not.
    merged = both.groupBy(*key).agg(
        F.first("_old", ignorenulls=True).alias("_old"), F.first("_new", ignorenulls=True).alias("_new")
    )
    reviewed = F.coalesce(F.col("_old.reviewed_by") == HUMAN, F.lit(False))
    live = fresh.select("table_name").distinct()
    kept_column = F.col("column_name").isNotNull() & reviewed
    out = merged.where(F.col("_new").isNotNull() | kept_column).join(live, "table_name", "left_semi")
    pick = F.when(reviewed, F.col("_old")).otherwise(F.col("_new"))
    return out.select(
        *key, pick["text"].alias("text"), pick["reviewed_by"].alias("reviewed_by"),
        F.when(reviewed, "existing").otherwise("fresh").alias("origin"),
    )


def merge_guard(existing: DataFrame, merged: DataFrame) -> DataFrame:
    """Reviewed entries before the merge, those lost, and whether the loss is too large."""
    key = ["table_name", "column_name"]
    before = existing.where(F.col("reviewed_by") == HUMAN).select(*key).withColumn("_a", F.lit(1))
    after = merged.select(*key).withColumn("_b", F.lit(1))
    both = join_null_safe(before, after, key, "left")
    total, lost = F.count(F.lit(1)), F.count_if(F.col("_b").isNull())
    return both.agg(
        total.alias("reviewed"), lost.alias("lost"),
        ((total > 0) & (lost > total * SHRINK_LIMIT)).alias("refuse"),
    )


def review_rows(catalogue: DataFrame, notes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every catalogue entry with its note; an entry without one has low confidence."""
    return catalogue.select(*key).join(notes, list(key), "left").withColumns({
        "reviewed_by": F.coalesce("reviewed_by", F.lit("")), "confidence": F.coalesce("confidence", F.lit("low")),
    })


def review_queue(rows: DataFrame) -> DataFrame:
    """Entries to look at first: not reviewed and of low confidence."""
    return rows.where((F.col("reviewed_by") != HUMAN) & (F.col("confidence") == "low"))


def review_progress(rows: DataFrame) -> DataFrame:
    """Queue length, confident entries hidden from it, and reviewed over all entries."""
    done, n = F.count_if(F.col("reviewed_by") == HUMAN), F.count(F.lit(1))
    waiting = F.col("reviewed_by") != HUMAN
    return rows.agg(
        F.count_if(waiting & (F.col("confidence") == "low")).alias("queued"),
        F.count_if(waiting & (F.col("confidence") == "high")).alias("hidden_confident"),
        done.alias("reviewed"), n.alias("entries"), ratio(done, n).alias("progress"),
    )


def is_opaque(name: Column) -> Column:
    """Names that say nothing: up to three letters and digits, one letter, or no vowel."""
    letters = F.lower(F.regexp_replace(name, "[^A-Za-z]", ""))
    code = name.rlike("^[A-Za-z]{1,3}[0-9]+$")
    return (F.length(name) > 0) & (
        code | (F.length(letters) == 1) | ((F.length(letters) >= 2) & ~letters.rlike("[aeiouy]"))
    )


def settled_confidence(name: Column, text: Column, confidence: Column) -> Column:
    """Low for opaque names, text in a foreign script, and unknown levels."""
    doubtful = F.coalesce(is_opaque(name), F.lit(False)) | F.coalesce(text.rlike(FOREIGN_SCRIPT), F.lit(False))
    return F.when(doubtful, "low").when(confidence.isin(*CONFIDENCE), confidence).otherwise("low")


def catalogue_size(tables: DataFrame, questions: DataFrame, database: str) -> DataFrame:
    """Databases that are asked about, questions, mean and largest number of tables."""
    asked = questions.groupBy(database).agg(F.count(F.lit(1)).alias("_q"))
    sizes = tables.groupBy(database).agg(F.count(F.lit(1)).alias("_t"))
    both = asked.join(sizes, database)
    return both.agg(
        F.count(F.lit(1)).alias("n_databases"), F.sum("_q").alias("n_questions"),
        ratio(F.sum("_t"), F.count(F.lit(1))).alias("mean_tables"), F.max("_t").alias("max_tables"),
    )
