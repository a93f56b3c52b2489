"""Numbers out of storage-engine text reports, and storage-engine health.

Extraction is a handful of regular expressions per distinct report; no line is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import parse_double, parse_u64, pinned, saturating_sub
from tidewatch.operators.distinct_texts import HASH, parse_once

# Field, label at the start of a line, which number, which match.
REPORT_FIELDS = [
    ("history_list_length", "History list length", "first", "last"),
    ("lsn", "Log sequence number", "final", "last"),
    ("log_flushed_up_to", "Log flushed up to", "final", "last"),
    ("pages_flushed_up_to", "Pages flushed up to", "final", "last"),
    ("last_checkpoint", "Last checkpoint at", "final", "last"),
    ("buffer_pool_pages", "Buffer pool size", "first", "first non-zero"),
    ("free_buffers", "Free buffers", "first", "first non-zero"),
    ("database_pages", "Database pages", "first", "first non-zero"),
    ("modified_pages", "Modified db pages", "first", "first non-zero"),
    ("os_wait_reservations", "OS WAIT ARRAY INFO: reservation count", "first", "last"),
]

# Health thresholds.
CHECKPOINT_WATCH, CHECKPOINT_BAD = 75.0, 90.0
DIRTY_LIMIT_DEFAULT = 75.0
DIRTY_WATCH_SHARE = 0.8
HIT_BAD, HIT_WATCH = 95.0, 99.0
HISTORY_WATCH, HISTORY_BAD = 100_000, 1_000_000
LONG_ROW_LOCK_MS = 10_000
DEFAULT_PAGE_SIZE = 16_384

_U64 = "decimal(20,0)"


def _zero() -> Column:
    return F.lit(0).cast(_U64)


def _report_number(report: Column, label: str, which: str, match: str) -> Column:
    # A number is a blank-delimited token; trailing commas and dots are allowed.
    gap = r"(?:[^\n]*?[ \t])??" if which == "first" else r"(?:[^\n]*[ \t])?"
    pattern = rf"(?m)^[ \t]*{label}{gap}\+?([0-9]+)[,.]*(?=[ \t\r]|$)"
    found = F.transform(F.regexp_extract_all(report, F.lit(pattern), F.lit(1)), parse_u64)
    if match == "last":
        value = F.try_element_at(found, F.lit(-1))
    else:
        value = F.get(F.filter(found, lambda v: v != 0), F.lit(0))
    return F.coalesce(value, _zero())


def parse_engine_reports(reports: DataFrame) -> DataFrame:
    """Ten numbers per report; one that is missing is 0 and costs no other.

    Each distinct text is parsed once, after the shuffle that found it.
    """
    labels = "|".join(label for _, label, _, _ in REPORT_FIELDS)

    def numbers(texts: DataFrame) -> DataFrame:
        # One pass over the text keeps the few lines that matter.
        lines = F.regexp_extract_all("report", F.lit(rf"(?m)^[ \t]*(?:{labels})[^\n]*"), F.lit(0))
        short = pinned(texts, "lines", F.array_join(lines, "\n"))
        found = [_report_number(F.col("lines"), lb, w, m).alias(f) for f, lb, w, m in REPORT_FIELDS]
        return short.select(HASH, "report", *found)

    return parse_once(reports.select("server", "snapshot_ts", "report"), "report", numbers)


def checkpoint_age() -> Column:
    return saturating_sub(F.col("lsn"), F.col("last_checkpoint")).cast(_U64)


def log_flush_lag() -> Column:
    return saturating_sub(F.col("lsn"), F.col("log_flushed_up_to")).cast(_U64)


# Settings read.
CONFIG_VARIABLES = [
    "innodb_buffer_pool_size", "innodb_buffer_pool_instances", "innodb_redo_log_capacity",
    "innodb_log_file_size", "innodb_log_files_in_group", "innodb_io_capacity",
    "innodb_io_capacity_max", "innodb_flush_log_at_trx_commit", "innodb_max_dirty_pages_pct",
    "innodb_page_size",
]


def engine_config(variables: DataFrame) -> DataFrame:
    """Storage-engine settings per server, with the fallbacks older versions need."""
    wide = (
        variables.where(F.col("name").isin(CONFIG_VARIABLES))
        .groupBy("server")
        .agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in CONFIG_VARIABLES])
    )

    def num(name: str) -> Column:
        return F.coalesce(parse_u64(F.col(name)), _zero())

    def at_least_one(c: Column) -> Column:
        return F.greatest(c, F.lit(1).cast(_U64))

    old_capacity = (num("innodb_log_file_size") * at_least_one(num("innodb_log_files_in_group"))).cast(_U64)
    capacity = num("innodb_redo_log_capacity")
    page = num("innodb_page_size")
    return wide.select(
        "server",
        num("innodb_buffer_pool_size").alias("buffer_pool_bytes"),
        at_least_one(num("innodb_buffer_pool_instances")).alias("buffer_pool_instances"),
        F.when(capacity == 0, old_capacity).otherwise(capacity).alias("redo_capacity_bytes"),
        num("innodb_io_capacity").alias("io_capacity"),
        num("innodb_io_capacity_max").alias("io_capacity_max"),
        num("innodb_flush_log_at_trx_commit").alias("flush_log_at_trx_commit"),
        F.coalesce(parse_double(F.col("innodb_max_dirty_pages_pct")), F.lit(0.0)).alias(
            "max_dirty_pages_pct"
        ),
        F.when(page == 0, F.lit(DEFAULT_PAGE_SIZE).cast(_U64)).otherwise(page).alias("page_size"),
    )


# Snapshot field, status counter.
SNAPSHOT_COUNTERS = {
    "pages_total": "Innodb_buffer_pool_pages_total",
    "pages_data": "Innodb_buffer_pool_pages_data",
    "pages_dirty": "Innodb_buffer_pool_pages_dirty",
    "pages_free": "Innodb_buffer_pool_pages_free",
    "read_requests": "Innodb_buffer_pool_read_requests",
    "disk_reads": "Innodb_buffer_pool_reads",
    "wait_free": "Innodb_buffer_pool_wait_free",
    "log_waits": "Innodb_log_waits",
    "row_lock_waits": "Innodb_row_lock_waits",
    "row_lock_current_waits": "Innodb_row_lock_current_waits",
    "row_lock_time_avg_ms": "Innodb_row_lock_time_avg",
    "row_lock_time_max_ms": "Innodb_row_lock_time_max",
    "data_reads": "Innodb_data_reads",
    "data_writes": "Innodb_data_writes",
    "data_fsyncs": "Innodb_data_fsyncs",
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(
        F.coalesce(whole, _zero()) > 0, part.cast("double") / whole.cast("double") * 100.0
    ).otherwise(F.lit(0.0))


def engine_snapshot(status: DataFrame, engine: DataFrame, config: DataFrame) -> DataFrame:
    """Counters, report and settings in one row per server.

    ``status`` is the latest sample per server as ``(server, variable, value)``,
    ``engine`` the parsed latest report. Servers without a report or settings
    keep their row. A counter that reads 0 yields to the report's number.
    """
    names = SNAPSHOT_COUNTERS
    counters = (
        status.where(F.col("variable").isin(list(names.values())))
        .groupBy("server")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("variable") == v, F.col("value"))), _zero()).alias(f)
                for f, v in names.items()
            ]
        )
    )
    joined = counters.join(engine.drop("snapshot_ts"), "server", "left").join(config, "server", "left")

    def or_report(counter: str, field: str) -> Column:
        reported = F.coalesce(F.col(field), _zero())
        return F.when(F.col(counter) == 0, reported).otherwise(F.col(counter))

    reports = {f: F.coalesce(F.col(f), _zero()) for f, _, _, _ in REPORT_FIELDS}
    filled = joined.withColumns(
        {
            "pages_total": or_report("pages_total", "buffer_pool_pages"),
            "pages_dirty": or_report("pages_dirty", "modified_pages"),
            "pages_free": or_report("pages_free", "free_buffers"),
        }
    ).withColumns(reports)
    hit = F.lit(1.0) - F.col("disk_reads").cast("double") / F.col("read_requests").cast("double")
    return filled.select(
        "server",
        "pages_total",
        "pages_data",
        "pages_dirty",
        "pages_free",
        _share(F.col("pages_dirty"), F.col("pages_total")).alias("dirty_pct"),
        F.when(
            F.col("read_requests") > 0,
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), hit)) * 100.0,
        )
        .otherwise(F.lit(100.0))
        .alias("hit_ratio_pct"),
        "wait_free",
        "log_waits",
        checkpoint_age().alias("checkpoint_age"),
        _share(checkpoint_age(), F.col("redo_capacity_bytes")).alias("checkpoint_age_pct"),
        log_flush_lag().alias("log_flush_lag"),
        "history_list_length",
        "row_lock_waits",
        "row_lock_current_waits",
        "row_lock_time_avg_ms",
        "row_lock_time_max_ms",
        "data_reads",
        "data_writes",
        "data_fsyncs",
        "os_wait_reservations",
        F.coalesce(F.col("max_dirty_pages_pct"), F.lit(0.0)).alias("max_dirty_pages_pct"),
    )


def band(value: Column, watch: Column | float, bad: Column | float) -> Column:
    return (
        F.when(value >= bad, F.lit("bad")).when(value >= watch, F.lit("watch")).otherwise(F.lit("good"))
    )


def engine_health(snapshot: DataFrame) -> DataFrame:
    limit = F.when(
        F.col("max_dirty_pages_pct") > 0, F.col("max_dirty_pages_pct")
    ).otherwise(F.lit(DIRTY_LIMIT_DEFAULT))
    hit = F.col("hit_ratio_pct")
    history = F.col("history_list_length")
    return snapshot.withColumns(
        {
            "checkpoint_health": band(F.col("checkpoint_age_pct"), CHECKPOINT_WATCH, CHECKPOINT_BAD),
            "dirty_health": band(F.col("dirty_pct"), limit * DIRTY_WATCH_SHARE, limit),
            "hit_ratio_health": F.when(hit < HIT_BAD, F.lit("bad"))
            .when(hit < HIT_WATCH, F.lit("watch"))
            .otherwise(F.lit("good")),
            "history_health": F.when(history > HISTORY_BAD, F.lit("bad"))
            .when(history > HISTORY_WATCH, F.lit("watch"))
            .otherwise(F.lit("good")),
        }
    )


def engine_warnings(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumns(
        {
            "warn_wait_free": F.col("wait_free") > 0,
            "warn_log_waits": F.col("log_waits") > 0,
            "warn_row_lock_waits": F.col("row_lock_current_waits") > 0,
            "warn_row_lock_time": F.col("row_lock_time_max_ms") > LONG_ROW_LOCK_MS,
        }
    )
