"""Access to a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared columns, so that opening a table reads no footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def file_state(spark: SparkSession, path: str) -> str:
    """A text that changes when a file under ``path`` is added, removed or rewritten; reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)")
    n, total = files.agg(F.count(F.lit(1)), F.sum(mark)).first()
    return f"{n}:{total}"


class Tables:
    """Callable that reads ``<folder>/<name>.parquet`` (a file or a directory)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(self.path(name))

    def spread(self, name: str, key: str) -> DataFrame:
        """The table over more tasks when its files give fewer than there are cores.

        For work that costs much per row, such as splitting texts. A table with enough
        splits is read as it is, without a shuffle.
        """
        df = self(name)
        splits, cores = df.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism
        return df if splits >= cores else df.repartition(min(cores, 8 * splits), key)
