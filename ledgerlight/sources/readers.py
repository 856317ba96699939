"""Reading tables, samples, JSON lines and nested catalogues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.scale import numbered

# Upper-case parts of a declared type, tried in this order, and the type they give.
DECLARED_TYPES = (
    (("DATETIME", "TIMESTAMP"), "timestamp"),
    (("INT",), "bigint"),
    (("CHAR", "CLOB", "TEXT"), "string"),
    (("BLOB",), "binary"),
    (("REAL", "FLOA", "DOUB"), "double"),
    (("NUMERIC", "DECIMAL"), "decimal(38,9)"),
    (("BOOL",), "boolean"),
)


def scan_sql(spark: SparkSession, statement: str, frames: Mapping[str, DataFrame], **args) -> DataFrame:
    """Run a parameterised SELECT over named frames; an empty result keeps its columns."""
    return spark.sql(statement, args=args or None, **frames)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, fetch: int = 2_000, **options: str
) -> DataFrame:
    """Read a database table in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, fetchsize=fetch, **options,
    ).load()


def first_rows(df: DataFrame, order: Sequence[Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order given by a hash of seed and key, so a repeat gives the same rows."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(mixed, key).limit(n)


def capped(df: DataFrame, order: Sequence[Column], max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows and whether more existed; ``order`` must be unique.

    The rows are numbered in parallel, so a large cap needs no task that holds them all.
    """
    more = df.agg(F.count(F.lit(1)) > max_rows).scalar()
    first = numbered(df, order, "_at").where(F.col("_at") <= max_rows).drop("_at")
    return first.withColumn("truncated", more)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with file and line number, blank lines counted but dropped.

    A split knows its offset in the file and the id grows inside it, so numbering by
    (offset, id) restores the line order while files are read in parallel.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
    )
    placed = numbered(raw, [F.col("_block").asc(), F.col("_id").asc()], "line_no", ["file"])
    return placed.where(F.trim("line") != "").select("file", "line_no", "line")


def parse_lines(df: DataFrame, text: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Parse JSON lines; a bad line keeps its text and a reason, a good one its fields in ``record``.

    Blank lines are dropped. A line must be an object holding all ``required`` fields.
    """
    rows = df.where(F.trim(text) != "").withColumn("_v", F.try_parse_json(text))
    reason = F.when(F.col("_v").isNull(), "invalid json line").when(
        ~F.schema_of_variant("_v").startswith("OBJECT"), "not an object"
    )
    for field in required:
        reason = reason.when(F.try_variant_get("_v", f"$.{field}", "string").isNull(), f"missing field {field}")
    return rows.withColumn("reason", reason.otherwise(F.lit(None).cast("string"))).withColumn(
        "record", F.when(F.col("reason").isNull(), F.from_json(text, schema))
    ).drop("_v")


def accept_reject(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reason; two filters over the same plan."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


CATALOGUE_SCHEMA = (
    "tables array<struct<name:string,description:string,primary_key:array<string>,"
    "columns:array<struct<name:string,type:string>>,foreign_keys:map<string,string>>>,"
    "cross_domain array<struct<table:string,column:string,target:string>>"
)


def catalogue_rows(df: DataFrame, text: str = "document") -> DataFrame:
    """Nested catalogue documents as rows of kind table, column or link.

    Cross-domain hints become links like declared foreign keys.
    """
    doc = df.select(F.from_json(text, CATALOGUE_SCHEMA).alias("d"))
    tables = doc.select(F.explode("d.tables").alias("t"))
    none = F.lit(None).cast("string")
    one = tables.select(F.lit("table").alias("kind"), F.col("t.name").alias("table_name"), none.alias("column_name"), F.col("t.description").alias("detail"))
    cols = tables.select("t.name", F.explode_outer("t.columns").alias("c")).where("c IS NOT NULL").select(
        F.lit("column").alias("kind"), F.col("name").alias("table_name"), F.col("c.name").alias("column_name"), F.col("c.type").alias("detail")
    )
    links = tables.select("t.name", F.explode_outer("t.foreign_keys").alias("k", "v")).where("k IS NOT NULL").select(
        F.lit("link").alias("kind"), F.col("name").alias("table_name"), F.col("k").alias("column_name"), F.col("v").alias("detail")
    )
    hints = doc.select(F.explode_outer("d.cross_domain").alias("h")).where("h IS NOT NULL").select(
        F.lit("link").alias("kind"), F.col("h.table").alias("table_name"), F.col("h.column").alias("column_name"), F.col("h.target").alias("detail")
    )
    return one.unionByName(cols).unionByName(links).unionByName(hints)


def with_schema(questions: DataFrame, schemas: DataFrame, database: str) -> DataFrame:
    """Questions whose database has a schema."""
    return questions.join(schemas.select(database).distinct(), database, "left_semi")


def declared_type(declared: Column) -> Column:
    """Concrete type of a declared type text; unknown or missing text gives string."""
    upper = F.upper(F.trim(F.coalesce(declared, F.lit(""))))
    chain = F.when(upper == "DATE", "date")
    for parts, kind in DECLARED_TYPES:
        hit = upper.contains(parts[0])
        for part in parts[1:]:
            hit = hit | upper.contains(part)
        chain = chain.when(hit, kind)
    return chain.otherwise("string")


def concrete_type(declared: str | None) -> str:
    """The same rule for one declared type, used while building a schema."""
    upper = (declared or "").strip().upper()
    if upper == "DATE":
        return "date"
    return next((kind for parts, kind in DECLARED_TYPES if any(p in upper for p in parts)), "string")


def load_typed(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Cast text columns to their declared types; what cannot be cast becomes null."""
    return df.select(*[
        F.col(f.name).try_cast(concrete_type(declared[f.name])).alias(f.name) if f.name in declared else F.col(f.name) for f in df.schema
    ])


def cast_failures(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Values per column that are present but not castable, from one pass."""
    one = df.agg(*[
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(concrete_type(d)).isNull()).alias(c) for c, d in declared.items()
    ])
    return one.unpivot([], list(declared), "column_name", "failures")
