"""The overview row of each server."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bands of the overview.
RUNNING_HIGH = 40.0
SLOW_HIGH = 1.0
HIT_LOW = 0.95

SHOWN = ["qps", "tps", "threads_running", "threads_connected", "slow_qps", "bp_hit_ratio", "conn_usage_pct"]


def dashboard_cards(derived: DataFrame, wait_summary: DataFrame, firing: DataFrame) -> DataFrame:
    """Newest metrics with their bands, lock waits and firing alerts.

    All three inputs are down to one row per server before they meet.
    """
    latest = (
        derived.groupBy("server")
        .agg(F.max_by(F.struct(*SHOWN), F.struct("t", "wall_ms")).alias("m"))
        .select("server", "m.*")
    )
    waits = wait_summary.groupBy("server").agg(
        F.max_by(F.struct("waits", "longest_secs"), "snapshot_ts").alias("w")
    )
    zero = F.lit(0).cast("bigint")
    return (
        latest.join(waits, "server", "left")
        .join(firing, "server", "left")
        .select(
            "server",
            *SHOWN,
            (F.col("threads_running") > RUNNING_HIGH).alias("running_high"),
            (F.col("slow_qps") > SLOW_HIGH).alias("slow_high"),
            (F.col("bp_hit_ratio") < HIT_LOW).alias("hit_low"),
            F.coalesce(F.col("w.waits"), zero).alias("lock_waits"),
            F.coalesce(F.col("w.longest_secs"), zero).alias("longest_wait_secs"),
            F.coalesce(F.col("firing"), zero).alias("firing"),
        )
    )
