"""Shared pieces: words, folds, stored intermediate tables, safe column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.session import ensure_checkpoint_dir

LONG_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder as Parquet and read it back.

    Cuts the lineage: a lost executor costs a reread, never a second computation with
    other rows. The folder goes when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete the files of a table from ``stored``, once everything made from it is written too."""
    sc = df.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that no column of ``taken`` has, whatever the case of letters."""
    used = {c.lower() for c in taken}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and the control characters 9 to 13."""
    return text.split() if text else []


def lowered(text: bytes | None) -> bytes:
    """A-Z in lower case, all else as it was."""
    return text.lower() if text else b""


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 33)], dtype=np.uint64)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit value for each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += mixed(hashes[k : k + n] + STEPS[k]) * STEPS[k]
    return mixed(total)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts of a batch as UTF-8, without a decoding step."""
    return column.cast(pa.binary()).to_pylist()


def mapped(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def long_list(arrays: list[np.ndarray]) -> pa.ListArray:
    """List column of 64-bit values from one array a row."""
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
