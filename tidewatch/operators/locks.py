"""Who waits for whom: lock waits, open transactions, metadata locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT = ["server", "snapshot_ts"]

# Seconds a wait may take before it is flagged.
LONG_WAIT_SECS = 10

LOCK_COLUMNS = ["lock_id", "lock_table", "index", "mode", "type"]


def normalize_locks(locks: DataFrame) -> DataFrame:
    """Either spelling of the lock table, as ``LOCK_COLUMNS``."""
    have = {c.lower() for c in locks.columns}
    if have.issuperset(LOCK_COLUMNS):
        return locks.select(*SNAPSHOT, *LOCK_COLUMNS)
    if "object_name" in have:
        table = F.concat(F.col("object_schema"), F.lit("."), F.col("object_name"))
        shape = {"lock_id": "lock_id", "index": "index", "mode": "mode", "type": "type"}
        cols = [table.alias("lock_table"), *[F.col(v).alias(k) for k, v in shape.items()]]
    else:
        shape = {
            "lock_id": "lock_id",
            "lock_table": "lock_table",
            "index": "lock_index",
            "mode": "lock_mode",
            "type": "lock_type",
        }
        cols = [F.col(v).alias(k) for k, v in shape.items()]
    return locks.select(*SNAPSHOT, *cols).select(*SNAPSHOT, *LOCK_COLUMNS)


def normalize_lock_tables(*tables: DataFrame) -> DataFrame:
    """Lock tables of a mixed fleet, old and new spelling, as one table."""
    out = normalize_locks(tables[0])
    for t in tables[1:]:
        out = out.unionByName(normalize_locks(t))
    return out


def seconds_between(start: Column, end: Column) -> Column:
    return F.coalesce(F.timestamp_diff("SECOND", start, end), F.lit(0).cast("bigint"))


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lock_waits(
    waits: DataFrame, trx: DataFrame, locks: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Each wait with both transactions, their sessions and the lock in question.

    All joins are equi-joins on ``(server, snapshot_ts, id)`` whose right side
    has one row per key, so no join grows the row count. A transaction that
    blocks many others makes a skewed left side, which AQE splits.
    """
    trx_cols = ["trx_id", "thread_id", "started", "wait_started", "query"]
    session_cols = ["id", "user", "host", "db"]

    def side(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
        return df.select(*SNAPSHOT, *[F.col(c).alias(prefix + c) for c in cols])

    def session_of(prefix: str) -> DataFrame:
        return side(sessions, session_cols, prefix).withColumnRenamed(
            prefix + "id", prefix + "thread_id"
        )

    joined = (
        waits.withColumnRenamed("requesting_trx", "w_trx_id")
        .withColumnRenamed("blocking_trx", "b_trx_id")
        .join(side(trx, trx_cols, "w_"), [*SNAPSHOT, "w_trx_id"])
        .join(side(trx, trx_cols, "b_"), [*SNAPSHOT, "b_trx_id"])
        .join(normalize_locks(locks), [*SNAPSHOT, "lock_id"], "left")
        .join(session_of("w_"), [*SNAPSHOT, "w_thread_id"], "left")
        .join(session_of("b_"), [*SNAPSHOT, "b_thread_id"], "left")
    )

    def party(prefix: str, since: str) -> Column:
        return F.struct(
            F.col(prefix + "trx_id").alias("trx_id"),
            F.coalesce(F.col(prefix + "thread_id"), F.lit(0).cast("bigint")).alias("thread_id"),
            *[_or_empty(prefix + c).alias(c) for c in ("user", "host", "db", "query")],
            seconds_between(F.col(prefix + since), F.col("snapshot_ts")).alias("secs"),
        )

    return joined.select(
        *SNAPSHOT,
        party("w_", "wait_started").alias("waiting"),
        party("b_", "started").alias("blocking"),
        F.translate(_or_empty("lock_table"), "`", "").alias("table"),
        _or_empty("index").alias("index"),
        _or_empty("mode").alias("lock_mode"),
        _or_empty("type").alias("lock_type"),
    )


def lock_party_who(user: Column, host: Column) -> Column:
    user = F.coalesce(user, F.lit(""))
    host = F.coalesce(host, F.lit(""))
    return (
        F.when(user == "", F.lit("?"))
        .when(host == "", user)
        .otherwise(F.concat(user, F.lit("@"), host))
    )


def lock_wait_summary(waits: DataFrame) -> DataFrame:
    """Waits per server and snapshot, and the longest of them."""
    return waits.groupBy(*SNAPSHOT).agg(
        F.count(F.lit(1)).alias("waits"),
        F.max(F.greatest(F.col("waiting.secs"), F.lit(0))).alias("longest_secs"),
    )


def long_wait(secs: Column) -> Column:
    return secs >= LONG_WAIT_SECS


def trx_waits(state: Column) -> Column:
    return F.contains(state, F.lit("LOCK WAIT"))


def mdl_pending(status: Column) -> Column:
    return F.upper(status) == "PENDING"
