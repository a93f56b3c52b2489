"""Session settings the jobs are designed for, and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE does the run-time work: it merges small shuffle partitions, turns a join
# into a broadcast only after it has measured the side, and splits a skewed
# partition even where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "tidewatch", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    ``spark.checkpoint.dir`` wins. Where it is unset a local master gets a
    temporary folder; a cluster without the setting is refused, because a
    machine-local folder would not survive the loss of an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
