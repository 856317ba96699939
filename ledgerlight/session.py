"""Session construction and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerlight", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; the cluster's own settings win over the
    defaults, ``conf`` over both."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    given = SparkConf()  # what the cluster's own files and the command line set
    chosen = {k: v for k, v in defaults.items() if not given.contains(k)} | conf
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; choose one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the copy.

    Used where a later step must see exactly the rows and partition numbers an
    earlier step saw, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
