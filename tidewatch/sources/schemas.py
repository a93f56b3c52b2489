"""Schemas of the snapshot tables the jobs read (DDL strings)."""

from __future__ import annotations

STATUS = "server string, session string, t double, wall_ms bigint, variable string, value_raw string"
VARIABLES = "server string, name string, value string"
PROCESSLIST = (
    "server string, snapshot_ts timestamp, id bigint, user string, host string, db string, "
    "command string, time bigint, state string, info string"
)
# Cumulative statement counters as the server keeps them; timers in picoseconds.
DIGESTS_RAW = (
    "server string, snapshot_ts timestamp, digest string, schema_name string, digest_text string, "
    "query_sample_text string, count_star bigint, sum_timer_wait decimal(20,0), "
    "avg_timer_wait decimal(20,0), max_timer_wait decimal(20,0), sum_lock_time decimal(20,0), "
    "sum_rows_examined bigint, sum_rows_sent bigint, sum_created_tmp_disk_tables bigint, "
    "sum_no_index_used bigint, sum_errors bigint"
)
STATEMENT_SAMPLES_RAW = (
    "server string, digest string, timer_start bigint, sql_text string, "
    "timer_wait decimal(20,0), lock_time decimal(20,0), rows_examined bigint, rows_sent bigint, "
    "no_index_used bigint, no_good_index_used bigint, created_tmp_disk_tables bigint, errors bigint"
)
INDEX_COLUMNS = (
    "server string, schema string, table string, index string, seq int, column string, "
    "non_unique int"
)
INDEX_USAGE = "server string, snapshot_ts timestamp, schema string, table string, index string, reads bigint, writes bigint"
CATALOG_TABLES = (
    "server string, schema string, table string, table_type string, engine string, "
    "table_rows bigint"
)
CATALOG_CONSTRAINTS = "server string, schema string, table string, constraint_type string"
CATALOG_COLUMNS = (
    "server string, schema string, table string, column string, column_type string, "
    "is_nullable string, column_key string, extra string, ordinal int"
)
TRX = (
    "server string, snapshot_ts timestamp, trx_id string, state string, thread_id bigint, "
    "started timestamp, wait_started timestamp, rows_locked bigint, rows_modified bigint, "
    "isolation string, query string"
)
LOCK_WAITS = (
    "server string, snapshot_ts timestamp, requesting_trx string, blocking_trx string, "
    "lock_id string"
)
LOCKS_NEW = (
    "server string, snapshot_ts timestamp, lock_id string, object_schema string, "
    "object_name string, index string, mode string, type string"
)
LOCKS_OLD = (
    "server string, snapshot_ts timestamp, lock_id string, lock_table string, "
    "lock_index string, lock_mode string, lock_type string"
)
METADATA_LOCKS = (
    "server string, snapshot_ts timestamp, object_type string, schema string, name string, "
    "lock_type string, lock_status string, thread_id bigint"
)
ENGINE_REPORTS = "server string, snapshot_ts timestamp, report string"
SERVERS = "server string, version string, version_comment string"

SNAPSHOT_TABLES = {
    "status": STATUS,
    "variables": VARIABLES,
    "processlist": PROCESSLIST,
    "digests": DIGESTS_RAW,
    "statement_samples": STATEMENT_SAMPLES_RAW,
    "index_columns": INDEX_COLUMNS,
    "index_usage": INDEX_USAGE,
    "tables": CATALOG_TABLES,
    "constraints": CATALOG_CONSTRAINTS,
    "columns": CATALOG_COLUMNS,
    "trx": TRX,
    "lock_waits": LOCK_WAITS,
    "locks_new": LOCKS_NEW,
    "locks_old": LOCKS_OLD,
    "metadata_locks": METADATA_LOCKS,
    "engine_reports": ENGINE_REPORTS,
    "servers": SERVERS,
}
