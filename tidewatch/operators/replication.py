"""Replication channels: one shape from either spelling, and their health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import parse_i64, parse_u64, saturating_sub

# Lag bands in seconds.
LAG_WATCH_SECS = 30
LAG_BAD_SECS = 300

RANKS = ["good", "watch", "bad"]

# Result column, source spellings (new, then old), kind.
REPLICA_FIELDS = [
    ("channel", ["Channel_Name"], "text"),
    ("source_host", ["Source_Host", "Master_Host"], "text"),
    ("source_port", ["Source_Port", "Master_Port"], "text"),
    ("source_user", ["Source_User", "Master_User"], "text"),
    ("io_running", ["Replica_IO_Running", "Slave_IO_Running"], "text"),
    ("sql_running", ["Replica_SQL_Running", "Slave_SQL_Running"], "text"),
    ("seconds_behind", ["Seconds_Behind_Source", "Seconds_Behind_Master"], "lag"),
    ("source_log_file", ["Source_Log_File", "Master_Log_File"], "text"),
    ("read_source_log_pos", ["Read_Source_Log_Pos", "Read_Master_Log_Pos"], "number"),
    ("relay_source_log_file", ["Relay_Source_Log_File", "Relay_Master_Log_File"], "text"),
    ("exec_source_log_pos", ["Exec_Source_Log_Pos", "Exec_Master_Log_Pos"], "number"),
    ("relay_log_space", ["Relay_Log_Space"], "number"),
    ("last_io_errno", ["Last_IO_Errno"], "text"),
    ("last_io_error", ["Last_IO_Error"], "text"),
    ("last_sql_errno", ["Last_SQL_Errno"], "text"),
    ("last_sql_error", ["Last_SQL_Error"], "text"),
    ("sql_state", ["Replica_SQL_Running_State", "Slave_SQL_Running_State"], "text"),
    ("auto_position", ["Auto_Position"], "text"),
    ("retrieved_gtid_set", ["Retrieved_Gtid_Set"], "text"),
    ("executed_gtid_set", ["Executed_Gtid_Set"], "text"),
    ("sql_delay", ["SQL_Delay"], "number"),
]
SOURCE_FIELDS = [
    ("file", ["File"], "text"),
    ("position", ["Position"], "number"),
    ("binlog_do_db", ["Binlog_Do_DB"], "text"),
    ("binlog_ignore_db", ["Binlog_Ignore_DB"], "text"),
    ("executed_gtid_set", ["Executed_Gtid_Set"], "text"),
]


def coalesce_aliases(df: DataFrame, names: list[str]) -> Column:
    """First spelling that is present and not NULL; ``''`` counts as a value."""
    by_lower = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), c)
    found = [F.col(f"`{by_lower[n.lower()]}`").cast("string") for n in names if n.lower() in by_lower]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _field(df: DataFrame, names: list[str], kind: str) -> Column:
    value = coalesce_aliases(df, names)
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    if kind == "text":
        return F.coalesce(value, F.lit(""))
    if kind == "lag":
        return parse_i64(trimmed)
    return F.coalesce(parse_u64(trimmed), F.lit(0).cast("decimal(20,0)"))


def normalize_replicas(df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Channel rows in one shape. ``seconds_behind`` stays NULL when unknown."""
    keep = ["server"] if carry is None else carry
    return df.select(*keep, *[_field(df, names, kind).alias(n) for n, names, kind in REPLICA_FIELDS])


def normalize_source(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Binary-log position per server, from the first row of its status."""
    fields = F.struct(*[_field(df, names, kind).alias(n) for n, names, kind in SOURCE_FIELDS])
    first_by = F.struct(*[F.col(c) for c in order]) if order else fields
    return (
        df.groupBy("server")
        .agg(F.min_by(fields, first_by).alias("s"))
        .select("server", "s.*", (F.col("s.file") != "").alias("logging"))
    )


def io_ok() -> Column:
    return F.lower(F.col("io_running")) == "yes"


def sql_ok() -> Column:
    return F.lower(F.col("sql_running")) == "yes"


def _errno_set(c: Column) -> Column:
    return (c != "") & (c != "0")


def has_error() -> Column:
    return _errno_set(F.col("last_io_errno")) | _errno_set(F.col("last_sql_errno"))


def apply_backlog_bytes() -> Column:
    """Received but not applied; NULL unless both positions are in one file."""
    same_file = (F.col("source_log_file") != "") & (
        F.col("source_log_file") == F.col("relay_source_log_file")
    )
    return F.when(
        same_file, saturating_sub(F.col("read_source_log_pos"), F.col("exec_source_log_pos"))
    )


def replica_health() -> Column:
    lag = F.col("seconds_behind")
    return (
        F.when(~io_ok() | ~sql_ok() | has_error(), F.lit("bad"))
        .when(lag.isNull() | (lag >= LAG_BAD_SECS), F.lit("bad"))
        .when(lag >= LAG_WATCH_SECS, F.lit("watch"))
        .otherwise(F.lit("good"))
    )


def _dash(c: Column) -> Column:
    return F.when(c == "", F.lit("-")).otherwise(c)


def replica_summary() -> Column:
    threads = F.concat(
        F.lit("IO "), _dash(F.col("io_running")), F.lit(" / SQL "), _dash(F.col("sql_running"))
    )
    return (
        F.when(~io_ok() | ~sql_ok(), threads)
        .when(F.col("seconds_behind").isNull(), F.lit("not replicating"))
        .otherwise(F.concat(F.col("seconds_behind").cast("string"), F.lit("s behind")))
    )


def replica_error() -> Column:
    """The error worth showing: the receiver's first, its number before its text."""
    out = None
    for side, errno, text in (
        ("IO", F.col("last_io_errno"), F.col("last_io_error")),
        ("SQL", F.col("last_sql_errno"), F.col("last_sql_error")),
    ):
        numbered = F.concat(F.lit(f"{side} thread error "), errno, F.lit(": "), text)
        out = F.when(_errno_set(errno), numbered) if out is None else out.when(_errno_set(errno), numbered)
        out = out.when(text != "", F.concat(F.lit(f"{side} thread: "), text))
    return out


def replica_diagnosis() -> Column:
    """What is wrong, in the order in which the causes hide one another."""
    return (
        F.when(~io_ok(), F.lit("receiver down"))
        .when(~sql_ok(), F.lit("applier stopped"))
        .when(F.col("seconds_behind").isNull(), F.lit("not replicating"))
        .when(F.coalesce(apply_backlog_bytes() > 0, F.lit(False)), F.lit("applier behind"))
        .when(F.col("sql_delay") > 0, F.lit("delayed on purpose"))
        .otherwise(F.lit("caught up"))
    )


def with_health(replicas: DataFrame) -> DataFrame:
    return replicas.withColumns(
        {
            "apply_backlog_bytes": apply_backlog_bytes(),
            "health": replica_health(),
            "summary": replica_summary(),
            "error_text": replica_error(),
            "diagnosis": replica_diagnosis(),
        }
    )


def overall_health(replicas: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """Worst channel per server; with ``servers``, NULL for those without one."""
    ranks = F.array(*[F.lit(r) for r in RANKS])
    rank = F.array_position(ranks, replica_health())
    worst = replicas.groupBy("server").agg(F.max(rank).alias("rank"))
    if servers is not None:
        worst = servers.select("server").join(worst, "server", "left")
    return worst.select("server", F.get(ranks, (F.col("rank") - 1).cast("int")).alias("health"))
