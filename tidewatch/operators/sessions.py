"""Process-list grouping and classification, per server and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import host_key, is_sleeping, matches_needle, user_key

# Default thresholds in seconds.
LONG_SECS = 10
IDLE_SECS = 60

SNAPSHOT = ["server", "snapshot_ts"]


def _sleeping() -> Column:
    return is_sleeping(F.col("command"))


def summarize_sessions(
    sessions: DataFrame, long_secs: int = LONG_SECS, idle_secs: int = IDLE_SECS
) -> DataFrame:
    time = F.col("time")
    return sessions.groupBy(*SNAPSHOT).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~_sleeping()).alias("active"),
        F.count_if(_sleeping()).alias("sleeping"),
        F.count_if(_sleeping() & (time >= idle_secs)).alias("idle_stale"),
        F.count_if(~_sleeping() & (time >= long_secs)).alias("long_running"),
    )


def session_breakdown(sessions: DataFrame) -> DataFrame:
    """By user and by host in one pass: ``(server, snapshot_ts, dimension, key, ...)``."""
    keyed = sessions.select(
        *SNAPSHOT,
        "time",
        _sleeping().alias("asleep"),
        user_key(F.col("user")).alias("by_user"),
        host_key(F.col("host")).alias("by_host"),
    )
    both = keyed.groupingSets(
        [[*SNAPSHOT, "by_user"], [*SNAPSHOT, "by_host"]], *SNAPSHOT, "by_user", "by_host"
    ).agg(
        F.grouping("by_user").alias("no_user"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("asleep")).alias("active"),
        F.count_if(F.col("asleep")).alias("sleeping"),
        F.greatest(F.max("time"), F.lit(0)).cast("bigint").alias("longest_secs"),
    )
    per_user = F.col("no_user") == 0
    return both.select(
        *SNAPSHOT,
        F.when(per_user, F.lit("user")).otherwise(F.lit("host")).alias("dimension"),
        F.when(per_user, F.col("by_user")).otherwise(F.col("by_host")).alias("key"),
        "total",
        "active",
        "sleeping",
        "longest_secs",
    )


def _sessions_by(sessions: DataFrame, key: Column) -> DataFrame:
    return (
        sessions.groupBy(*SNAPSHOT, key.alias("key"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(~_sleeping()).alias("active"),
            F.count_if(_sleeping()).alias("sleeping"),
            F.greatest(F.max("time"), F.lit(0)).cast("bigint").alias("longest_secs"),
        )
        .orderBy(*SNAPSHOT, F.desc("total"), "key")
    )


def sessions_by_user(sessions: DataFrame) -> DataFrame:
    """Biggest group first, then by key."""
    return _sessions_by(sessions, user_key(F.col("user")))


def sessions_by_host(sessions: DataFrame) -> DataFrame:
    return _sessions_by(sessions, host_key(F.col("host")))


def long_running_sessions(sessions: DataFrame, long_secs: int = LONG_SECS) -> DataFrame:
    """Statements in flight for at least ``long_secs``, longest first."""
    return sessions.where(~_sleeping() & (F.col("time") >= long_secs)).orderBy(
        F.desc("time"), "server", "id"
    )


def idle_sessions(sessions: DataFrame, idle_secs: int = IDLE_SECS) -> DataFrame:
    """Sleepers holding a connection for at least ``idle_secs``, longest first."""
    return sessions.where(_sleeping() & (F.col("time") >= idle_secs)).orderBy(
        F.desc("time"), "server", "id"
    )


def filter_sessions(
    sessions: DataFrame, needle: str = "", hide_sleeping: bool = False
) -> DataFrame:
    if hide_sleeping:
        sessions = sessions.where(~_sleeping())
    if needle:
        cols = [F.col(c) for c in ("user", "db", "state", "info")]
        sessions = sessions.where(matches_needle(needle, *cols))
    return sessions
