"""Loads of text tables into typed ones, batch by batch, each batch once.

A batch writes its typed rows and its failed casts into folders of its own number and then a
line into the ledger. A batch the ledger holds is not written again, and rows of a batch it does
not hold are not read, so a load that broke off or is played back changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.sources.readers import concrete_type, load_typed

LEDGER = "batch long, n_rows long, n_failures long"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def failed_casts(df: DataFrame, key: str, declared: Mapping[str, str]) -> DataFrame:
    """``(key, column_name, value, reason)`` for every value that its declared type cannot hold."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("value"), F.lit(f"no {concrete_type(d)}").alias("reason"),
            (F.col(c).isNotNull() & F.col(c).try_cast(concrete_type(d)).isNull()).alias("bad"),
        )
        for c, d in declared.items()
    ]
    return df.select(F.col(key).alias("key"), F.inline(F.array(*cells))).where("bad").drop("bad")


def load_batch(batch: DataFrame, number: int, folder: str, key: str, declared: Mapping[str, str]) -> bool:
    """Load one batch of text rows; False if the ledger already holds it."""
    spark = batch.sparkSession
    if _exists(spark, f"{folder}/ledger/batch={number}/_SUCCESS"):
        return False
    load_typed(batch, declared).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    failed_casts(batch, key, declared).write.mode("overwrite").parquet(f"{folder}/failures/batch={number}")
    n_rows, n_failures = (spark.read.parquet(f"{folder}/{part}/batch={number}").count() for part in ("rows", "failures"))
    line = spark.range(1).select(F.lit(n_rows).cast("long").alias("n_rows"), F.lit(n_failures).cast("long").alias("n_failures"))
    line.write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")
    return True


def load_stream(stream: DataFrame, folder: str, key: str, declared: Mapping[str, str]) -> StreamingQuery:
    """Load what a stream of text rows holds; state and ledger lie in ``folder``."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: load_batch(batch, number, folder, key, declared) and None)
    return writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def loaded(spark: SparkSession, folder: str, part: str = "rows") -> DataFrame:
    """Rows (or ``failures``) of the batches in the ledger, with the column ``batch``."""
    ledger = spark.read.parquet(f"{folder}/ledger").select(F.col("batch").cast("long").alias("batch"))
    rows = spark.read.parquet(f"{folder}/{part}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(ledger, "batch", "left_semi")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/ledger").select(F.col("batch").cast("long").alias("batch"), "n_rows", "n_failures")
