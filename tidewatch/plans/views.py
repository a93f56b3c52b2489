"""Monitoring-shaped tables derived from a generic star schema.

Each view is one SELECT over the whole of its tables, written once and rendered
for Spark or for ANSI SQL, so that a job and its check start from equal rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Spark:
    div = "div"

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def text(self, e: str) -> str:
        return f"CAST({e} AS STRING)"

    def micros(self, c: str) -> str:
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})"

    def seconds_ts(self, e: str) -> str:
        return f"timestamp_seconds({e})"

    def unpivot(self, src: str, ids: list[str], names: tuple[str, str], pairs: list[tuple[str, str]]) -> str:
        cells = ", ".join(f"'{k}', {v}" for k, v in pairs)
        key, value = names
        return (
            f"SELECT {', '.join(ids)}, {key}, {value} FROM ({src}) w "
            f"LATERAL VIEW stack({len(pairs)}, {cells}) x AS {key}, {value} WHERE {value} IS NOT NULL"
        )

    def series(self, src: str, upto: str, alias: str) -> str:
        return f"SELECT w.*, {alias} FROM ({src}) w LATERAL VIEW explode(sequence(1, {upto})) x AS {alias}"

    def pairs(self, items: list[tuple[str, str]]) -> str:
        return "array(" + ", ".join(f"struct('{k}' AS column, {v} AS value)" for k, v in items) + ")"


class Ansi:
    div = "//"

    def table(self, name: str) -> str:
        return name

    def text(self, e: str) -> str:
        return f"CAST({e} AS VARCHAR)"

    def micros(self, c: str) -> str:
        return f"epoch_us({c})"

    def seconds_ts(self, e: str) -> str:
        return f"({e})"  # plain seconds: results never show a timestamp

    def unpivot(self, src: str, ids: list[str], names: tuple[str, str], pairs: list[tuple[str, str]]) -> str:
        key, value = names
        cells = ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in pairs)
        return (
            f"SELECT {', '.join(ids)}, u.k AS {key}, u.v AS {value} FROM ({src}) w, "
            f"unnest([{cells}]) AS x(u) WHERE u.v IS NOT NULL"
        )

    def series(self, src: str, upto: str, alias: str) -> str:
        return f"SELECT w.*, {alias} FROM ({src}) w, unnest(range(1, {upto} + 1)) AS x({alias})"


# Event type to metric key.
EVENT_METRIC = {
    "error": "slow_qps",
    "click": "threads_running",
    "view": "bp_hit_pct",
    "purchase": "bytes_in_s",
    "signup": "conn_usage_pct",
}


def metrics(d) -> str:
    key = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_METRIC.items())
    us = d.micros("ts")
    return (
        f"SELECT concat('s', {d.text('user_id % 4')}) AS server, "
        f"concat('k', {d.text(f'({us} {d.div} 864000000000)')}) AS session, "
        f"CASE event_type {key} END AS metric, {us} {d.div} 1000 AS ts, "
        f"CAST(floor(value * 100) AS DOUBLE) AS value, event_id AS seq FROM {d.table('events')}"
    )


def status_wide(d) -> str:
    def n(kind: str) -> str:
        return f"sum(CASE WHEN event_type = '{kind}' THEN 1 ELSE 0 END)"

    def run(c: str) -> str:
        return f"CAST(sum({c}) OVER (PARTITION BY srv ORDER BY hr) AS BIGINT) AS r_{c}"

    kinds = ["error", "click", "view", "purchase", "signup"]
    hourly = (
        f"SELECT user_id % 4 AS srv, {d.micros('ts')} {d.div} 3600000000 AS hr, count(*) AS n, "
        + ", ".join(f"{n(k)} AS {k}" for k in kinds)
        + f", sum(CAST(floor(value * 100) AS BIGINT)) AS cents FROM {d.table('events')} GROUP BY 1, 2"
    )
    return (
        f"SELECT concat('s', {d.text('srv')}) AS server, concat('k', {d.text(f'hr {d.div} 200')}) AS session, "
        "CAST(hr * 3600 AS DOUBLE) AS t, hr * 3600000 AS wall_ms, srv, hr, n, click, "
        + ", ".join(run(c) for c in ["n", *kinds, "cents"])
        + f" FROM ({hourly}) h"
    )


STATUS_COUNTERS = [
    ("Queries", "r_n % 500"),
    ("Slow_queries", "r_error % 50"),
    ("Handler_commit", "CASE WHEN srv < 3 THEN r_purchase END"),
    ("Handler_rollback", "CASE WHEN srv < 3 THEN r_error % 9 END"),
    ("Com_commit", "r_signup"),
    ("Com_rollback", "r_click % 40"),
    ("Bytes_received", "r_cents"),
    ("Bytes_sent", "r_cents * 3 % 1000000"),
    ("Innodb_rows_read", "r_n * 7"),
    ("Innodb_rows_inserted", "r_click"),
    ("Innodb_rows_updated", "r_view"),
    ("Innodb_rows_deleted", "r_error"),
    ("Innodb_buffer_pool_reads", "r_error % 30"),
    ("Innodb_buffer_pool_read_requests", "r_view % 90"),
    ("Table_locks_waited", "r_signup % 20"),
    ("Aborted_connects", "r_error % 7"),
    ("Created_tmp_disk_tables", "r_view"),
    ("Threads_connected", "n"),
    ("Threads_running", "click"),
    ("Uptime", "hr * 3600 - 1704000000"),
    ("Innodb_buffer_pool_pages_total", "CASE WHEN srv = 1 THEN 0 ELSE 8192 END"),
    ("Innodb_buffer_pool_pages_data", "r_n % 8000"),
    ("Innodb_buffer_pool_pages_dirty", "r_view % 7000"),
    ("Innodb_buffer_pool_pages_free", "r_click % 2"),
    ("Innodb_buffer_pool_wait_free", "r_error % 2"),
    ("Innodb_log_waits", "r_click % 3"),
    ("Innodb_row_lock_waits", "r_signup"),
    ("Innodb_row_lock_current_waits", "r_signup % 2"),
    ("Innodb_row_lock_time_avg", "r_view % 100"),
    ("Innodb_row_lock_time_max", "r_view * 20"),
    ("Innodb_data_reads", "r_n"),
    ("Innodb_data_writes", "r_view"),
    ("Innodb_data_fsyncs", "r_click"),
]


def status(d) -> str:
    pairs = [(k, d.text(v)) for k, v in STATUS_COUNTERS]
    pairs += [("Innodb_page_cleaner", "'ON'"), ("Load_average", "concat('1.', " + d.text("n") + ")")]
    return d.unpivot(
        status_wide(d), ["server", "session", "t", "wall_ms"], ("variable", "value_raw"), pairs
    )


def servers(d) -> str:
    """One server per customer, over the versions in the field."""
    versions = [
        ("8.4.3", "harbour build"), ("5.7.31-debug", ""), ("8.0.12", ""), ("5.6.49", ""),
        ("10.9.8-MariaDB-harbour", ""), ("5.7.40-43", "percona, packed by us"),
        ("10.5.0-mariadb", ""), ("not told", ""), ("8.0.22", "from source"), ("5.7.3", ""),
    ]

    def pick(i: int) -> str:
        whens = " ".join(f"WHEN {k} THEN '{v[i]}'" for k, v in enumerate(versions))
        return f"CASE c_custkey % {len(versions)} {whens} END"

    return (
        f"SELECT concat('c', {d.text('c_custkey')}) AS server, {pick(0)} AS version, "
        f"{pick(1)} AS version_comment FROM {d.table('customer')}"
    )


def variables(d) -> str:
    """Settings per supplier, some of them missing or in their older form."""
    k = "s_suppkey"
    src = f"SELECT concat('s', {d.text(k)}) AS server, {k} FROM {d.table('supplier')}"
    pairs = [
        ("max_connections", f"CASE WHEN {k} % 5 <> 0 THEN {d.text(f'{k} % 7 * 50')} END"),
        ("wait_timeout", "'28800'"),
        ("interactive_timeout", f"CASE WHEN {k} % 2 = 0 THEN 'n/a' ELSE '600' END"),
        ("innodb_buffer_pool_size", "'134217728'"),
        ("innodb_buffer_pool_instances", f"{d.text(f'{k} % 3')}"),
        ("innodb_redo_log_capacity", f"CASE WHEN {k} % 3 = 0 THEN '1500000' ELSE '0' END"),
        ("innodb_log_file_size", "'500000'"),
        ("innodb_log_files_in_group", f"CASE WHEN {k} % 4 <> 0 THEN {d.text(f'{k} % 4')} END"),
        ("innodb_io_capacity", "'200'"),
        ("innodb_flush_log_at_trx_commit", f"{d.text(f'{k} % 3')}"),
        ("innodb_max_dirty_pages_pct", f"CASE WHEN {k} % 2 = 0 THEN '90.5' END"),
        ("innodb_page_size", f"CASE WHEN {k} % 6 = 0 THEN '4096' END"),
    ]
    return d.unpivot(src, ["server"], ("name", "value"), pairs)


# An order is a session and, if open, a transaction. Class 0 of three holds a
# third of all rows: one server, and one transaction that blocks all others.
_SERVER = "CASE WHEN o_orderkey % 3 = 0 THEN 's0' ELSE concat('s', {n}) END"
_NOW = 1_700_000_000


def _server(d) -> str:
    return _SERVER.format(n=d.text("o_orderkey % 3 + 1"))


def processlist(d) -> str:
    k = "o_orderkey"
    port = d.text(f"40000 + {k} % 20000")
    return f"""
    SELECT {_server(d)} AS server, {d.seconds_ts(f'{_NOW} + {k} % 4 * 60')} AS snapshot_ts, {k} AS id,
      CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('user', {d.text('o_custkey % 37')}) END AS user,
      CASE {k} % 6 WHEN 0 THEN concat('10.0.0.', {d.text('o_custkey % 9')}, ':', {port})
        WHEN 1 THEN concat('[::1]:', {port}) WHEN 2 THEN '::1' WHEN 3 THEN ''
        WHEN 4 THEN 'localhost' ELSE concat('app', {d.text('o_custkey % 5')}, '.lan:', {port}) END AS host,
      CASE {k} % 4 WHEN 0 THEN 'shop' WHEN 1 THEN '' ELSE 'Billing' END AS db,
      CASE WHEN o_orderstatus = 'O' THEN (CASE WHEN {k} % 2 = 0 THEN 'Sleep' ELSE 'SLEEP' END)
        ELSE 'Query' END AS command,
      {k} % 600 AS time,
      CASE WHEN o_orderstatus = 'P' THEN 'updating' ELSE '' END AS state,
      CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('SELECT ', o_orderpriority) END AS info
    FROM {d.table('orders')}"""


def trx(d) -> str:
    k = "o_orderkey"
    started = f"{_NOW} - {k} % 3000"
    waiting = f"CASE WHEN o_orderstatus = 'P' THEN {d.seconds_ts(f'{_NOW} - {k} % 40')} END"
    return f"""
    SELECT {_server(d)} AS server, {d.seconds_ts(f'{_NOW}')} AS snapshot_ts,
      concat('t', {d.text(k)}) AS trx_id,
      CASE WHEN o_orderstatus = 'P' THEN 'LOCK WAIT' ELSE 'RUNNING' END AS state,
      CASE WHEN {k} % 13 = 0 THEN NULL ELSE {k} END AS thread_id,
      {d.seconds_ts(started)} AS started, {waiting} AS wait_started,
      {k} % 50 AS rows_locked, {k} % 20 AS rows_modified,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE 'REPEATABLE READ' END AS isolation,
      CASE WHEN {k} % 5 = 0 THEN NULL ELSE concat('UPDATE o SET p = ', {d.text(k)}) END AS query
    FROM {d.table('orders')}"""


def lock_waits(d) -> str:
    k = "o_orderkey"
    blocker = f"CASE WHEN {k} % 3 = 0 THEN 0 WHEN {k} >= 30 THEN {k} - 30 ELSE {k} % 3 END"
    return f"""
    SELECT {_server(d)} AS server, {d.seconds_ts(f'{_NOW}')} AS snapshot_ts,
      concat('t', {d.text(k)}) AS requesting_trx, concat('t', {d.text(blocker)}) AS blocking_trx,
      concat('l', {d.text(k)}) AS lock_id
    FROM {d.table('orders')} WHERE o_orderstatus = 'P' AND {k} > 2"""


def locks_new(d) -> str:
    k = "o_orderkey"
    return f"""
    SELECT {_server(d)} AS server, {d.seconds_ts(f'{_NOW}')} AS snapshot_ts,
      concat('l', {d.text(k)}) AS lock_id, 'shop' AS object_schema, o_orderpriority AS object_name,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE 'PRIMARY' END AS index, 'X' AS mode, 'RECORD' AS type
    FROM {d.table('orders')} WHERE o_orderstatus = 'P' AND {k} % 2 = 0"""


def locks_old(d) -> str:
    k = "o_orderkey"
    return f"""
    SELECT {_server(d)} AS server, {d.seconds_ts(f'{_NOW}')} AS snapshot_ts,
      concat('l', {d.text(k)}) AS lock_id, concat('`shop`.`', o_orderpriority, '`') AS lock_table,
      'idx_old' AS lock_index, 'S' AS lock_mode, 'RECORD' AS lock_type
    FROM {d.table('orders')} WHERE o_orderstatus = 'P' AND {k} % 2 = 1 AND {k} % 5 <> 0"""


def metadata_locks(d) -> str:
    k = "o_orderkey"
    return f"""
    SELECT {_server(d)} AS server, {d.seconds_ts(f'{_NOW}')} AS snapshot_ts, 'TABLE' AS object_type,
      CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN 'performance_schema' ELSE 'shop' END AS schema,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE o_orderpriority END AS name,
      'SHARED_READ' AS lock_type,
      CASE {k} % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'Pending' ELSE 'GRANTED' END AS lock_status,
      CASE WHEN {k} % 7 = 0 THEN NULL ELSE {k} END AS thread_id
    FROM {d.table('orders')}"""


# Statement templates with the shape each must give. None where
# the statement cannot be judged. Fields: schema, table, equality, range,
# order_by, wrapped_columns.
TEMPLATES = [
    ("SELECT gauge , level FROM `harbour` . `readings` AS r WHERE r . gauge = ? AND r . level BETWEEN ? AND ? "
     "AND r . quality = ? ORDER BY r . taken",
     ("harbour", "readings", ["gauge", "quality"], "level", ["taken"], [])),
    ("SELECT max ( draught ) FROM vessels WHERE flag IN ( ? , ? , ? ) AND Flag = ? GROUP BY hull HAVING count ( * ) > ?",
     (None, "vessels", ["flag"], None, [], [])),
    ("SELECT * FROM vessels WHERE YEAR ( built ) = ? AND owner LIKE ? AND retired IS NULL",
     (None, "vessels", ["retired"], "owner", [], ["built"])),
    ("SELECT id FROM moorings WHERE ( ( pier = ? ) AND ( depth >= ? ) ) ORDER BY depth LIMIT ? OFFSET ?",
     (None, "moorings", ["pier"], "depth", ["depth"], [])),
    ("SELECT v . name FROM vessels v LEFT JOIN calls c ON c . vessel = v . id WHERE c . port = ?", None),
    ("SELECT id FROM tolls WHERE paid = ? AND ( payer = ? OR agent = ? )", None),
    ("DELETE FROM tolls WHERE due < ?", None),
    ("SELECT id FROM calls WHERE port = ? UNION ALL SELECT id FROM calls_old WHERE port = ?", None),
    ("SELECT id FROM calls WHERE vessel = ( SELECT max ( id ) FROM vessels )", None),
    ("SELECT c . id FROM calls c , vessels v WHERE v . id = c . vessel", None),
    ("SELECT `berth no` FROM `harbour` . `moorings` WHERE `key` = ? AND `berth no` <> ? AND beam < ? AND width < ?",
     ("harbour", "moorings", ["key"], "beam", [], [])),
    ("SELECT * FROM calls ORDER BY arrived DESC , ROUND ( stay )",
     (None, "calls", [], None, ["arrived"], [])),
    ("SELECT * FROM pilots WHERE COALESCE ( LOWER ( TRIM ( name ) ) , ? ) = ? AND licence <=> ?",
     (None, "pilots", ["licence"], None, [], ["LOWER"])),
    ("SELECT name FROM pilots WHERE port = ? AND licence IS NOT NULL AND grade NOT IN ( ? ) AND hired > ? AND hired < ?",
     (None, "pilots", ["port"], "hired", [], [])),
    ("SELECT r . level FROM readings r WHERE r . taken >= ? AND r . GAUGE = ? ORDER BY r . taken , r . level DESC",
     (None, "readings", ["GAUGE"], "taken", ["taken", "level"], [])),
    ("INSERT INTO calls ( vessel , port ) VALUES ( ? , ? )", None),
    ("SELECT count ( * ) FROM tolls WHERE payer = ? AND Payer > ? AND amount > ?",
     (None, "tolls", ["payer"], "amount", [], [])),
]


def _template(key: str) -> str:
    whens = " ".join(
        f"WHEN {i} THEN '{t[0]}'" for i, t in enumerate(TEMPLATES)
    )
    return f"CASE {key} % {len(TEMPLATES)} {whens} END"


def digests(d) -> str:
    """Statement counters in ms: one digest per part, on the server it maps to."""
    q, price = "CAST(l_quantity AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)"

    def total(e: str) -> str:
        return f"CAST(sum({e}) AS BIGINT)"

    grouped = f"""
    SELECT l_partkey AS p, count(*) AS n, {total(q)} AS ms, max({q}) AS max_ms, {total(price)} AS examined,
      {total(f"CASE WHEN l_returnflag = 'R' THEN {q} ELSE 0 END")} AS sent,
      {total("CASE WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 1 ELSE 0 END")} AS no_index,
      {total("CASE WHEN l_partkey % 5 = 0 THEN l_linenumber ELSE 0 END")} AS tmp
    FROM {d.table('lineitem')} GROUP BY l_partkey"""
    return f"""
    SELECT concat('s', {d.text('p % 4')}) AS server, concat('digest-', {d.text('p')}) AS digest,
      CASE WHEN p % 7 = 0 THEN '' ELSE 'roster' END AS schema,
      CASE WHEN p % 50 = 49 THEN NULL ELSE {_template('p')} END AS digest_text,
      CASE WHEN p % 50 = 49 THEN '' ELSE {_template('p')} END AS text,
      n AS count, CAST(ms AS DOUBLE) AS total_ms, CAST(ms {d.div} n AS DOUBLE) AS avg_ms,
      CAST(max_ms AS DOUBLE) AS max_ms, CAST(0 AS DOUBLE) AS lock_ms, examined AS rows_examined,
      sent AS rows_sent, tmp AS tmp_disk_tables, no_index AS no_index_used, CAST(0 AS BIGINT) AS errors
    FROM ({grouped}) g"""


def digests_raw(d) -> str:
    """The same facts the way a server reports them: picoseconds, gaps."""
    q = "CAST(l_quantity AS BIGINT)"
    return f"""
    SELECT concat('s', {d.text('p % 4')}) AS server,
      CASE WHEN p % 9 = 0 THEN NULL ELSE concat('digest-', {d.text('p')}) END AS digest,
      CASE WHEN p % 7 = 0 THEN NULL ELSE 'roster' END AS schema_name,
      {_template('p')} AS digest_text,
      CASE WHEN p % 4 < 2 THEN concat('/* app */ ', {_template('p')}) END AS query_sample_text,
      n AS count_star, ms * 1000000000 AS sum_timer_wait, max_ms * 1000000000 AS max_timer_wait, p
    FROM (SELECT l_partkey AS p, count(*) AS n, CAST(sum({q}) AS BIGINT) AS ms, max({q}) AS max_ms
          FROM {d.table('lineitem')} GROUP BY l_partkey) g"""


def samples_raw(d) -> str:
    """Executions of statements. Digest 0 has a third of them."""
    return f"""
    SELECT concat('s', {d.text('l_suppkey % 4')}) AS server,
      concat('d', {d.text('CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey % 200 END')}) AS digest,
      l_orderkey * 64 + l_linenumber AS timer_start,
      concat('q', {d.text('l_partkey')}, '/', {d.text('l_suppkey')}, '/', {d.text('CAST(l_quantity AS BIGINT)')},
        '/', {d.text('CAST(floor(l_extendedprice * 100) AS BIGINT)')}) AS sql_text,
      CAST(l_quantity AS BIGINT) * 1000000000 AS timer_wait, CAST(0 AS BIGINT) AS lock_time,
      CAST(floor(l_extendedprice) AS BIGINT) AS rows_examined, CAST(l_quantity AS BIGINT) AS rows_sent,
      l_partkey % 2 AS no_index_used, l_suppkey % 3 AS no_good_index_used,
      CAST(0 AS BIGINT) AS created_tmp_disk_tables, CAST(NULL AS BIGINT) AS errors
    FROM {d.table('lineitem')}"""


def _table_no(d, key: str = "p_partkey") -> str:
    return f"{key} {d.div} 8"


def index_columns(d) -> str:
    src = f"""
    SELECT concat('s', {d.text(f'{_table_no(d)} % 4')}) AS server,
      CASE WHEN {_table_no(d)} % 9 = 8 THEN 'sys' ELSE 'shop' END AS schema,
      concat('t', {d.text(_table_no(d))}) AS tbl,
      CASE WHEN p_partkey % 8 = 0 THEN 'PRIMARY' ELSE concat('ix', {d.text('p_partkey')}) END AS idx,
      CASE WHEN p_partkey % 8 = 0 OR p_partkey % 5 = 0 THEN 0 ELSE 1 END AS non_unique,
      p_size FROM {d.table('part')}"""
    exploded = d.series(src, "p_size % 3 + 1", "seq")
    return (
        f"SELECT server, schema, tbl AS table_, idx AS index_, CAST(seq AS INT) AS seq, "
        f"concat('c', {d.text('(p_size % 2 + seq) % 4')}) AS column_, non_unique FROM ({exploded}) e"
    )


# Indexes the workload templates meet: schema, table, index, columns.
WORKLOAD_INDEXES = [
    ("roster", "vessels", "ix_flag", ["flag", "hull"]),
    ("ROSTER", "Pilots", "ix_port", ["port", "hired", "name", "grade"]),
    ("roster", "pilots", "ix_licence", ["LICENCE"]),
    ("harbour", "readings", "ix_gauge", ["gauge"]),
    ("roster", "tolls", "ix_payer", ["payer"]),
    ("harbour", "moorings", "ix_beam", ["beam", "key"]),
    ("roster", "vessels", "b_retired", ["retired"]),
    ("roster", "vessels", "a_retired", ["Retired"]),
]


def workload_indexes(d) -> str:
    """Those indexes on three of the four servers."""
    n = len(WORKLOAD_INDEXES)

    def pick(i: int) -> str:
        return "CASE k " + " ".join(f"WHEN {j} THEN '{w[i]}'" for j, w in enumerate(WORKLOAD_INDEXES)) + " END"

    def column(j: int) -> str:
        cols = WORKLOAD_INDEXES[j][3]
        return "CASE seq " + " ".join(f"WHEN {s + 1} THEN '{c}'" for s, c in enumerate(cols)) + " END"

    columns = "CASE k " + " ".join(f"WHEN {j} THEN {column(j)}" for j in range(n)) + " END"
    src = f"""SELECT DISTINCT concat('s', {d.text(f'p_partkey {d.div} {n} % 3')}) AS server, p_partkey % {n} AS k
      FROM {d.table('part')}"""
    return f"""
    SELECT server, {pick(0)} AS schema, {pick(1)} AS table_, {pick(2)} AS index_, CAST(seq AS INT) AS seq,
      {columns} AS column_, 1 AS non_unique
    FROM ({d.series(src, '4', 'seq')}) e WHERE {columns} IS NOT NULL"""


def index_usage(d) -> str:
    return f"""
    SELECT concat('s', {d.text(f'{_table_no(d)} % 4')}) AS server,
      CASE WHEN {_table_no(d)} % 9 = 8 THEN 'sys' ELSE 'shop' END AS schema,
      concat('t', {d.text(_table_no(d))}) AS table_,
      CASE WHEN p_partkey % 8 = 0 THEN 'PRIMARY' WHEN p_partkey % 8 = 7 THEN NULL
        WHEN p_partkey % 8 = 6 THEN concat('gone', {d.text('p_partkey')})
        ELSE concat('ix', {d.text('p_partkey')}) END AS index_,
      CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS reads,
      coalesce(n, 0) * 2 AS writes
    FROM {d.table('part')} LEFT JOIN
      (SELECT l_partkey, count(*) AS n FROM {d.table('lineitem')} GROUP BY l_partkey) l
      ON l_partkey = p_partkey"""


def tables(d) -> str:
    t = "tno"
    return f"""
    SELECT concat('s', {d.text(f'{t} % 4')}) AS server,
      CASE WHEN {t} % 9 = 8 THEN 'sys' ELSE 'shop' END AS schema, concat('t', {d.text(t)}) AS table_,
      CASE WHEN {t} % 10 = 9 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
      CASE WHEN {t} % 10 = 9 THEN NULL ELSE 'InnoDB' END AS engine,
      CASE WHEN {t} % 10 = 9 THEN NULL ELSE size * size * 5 END AS table_rows
    FROM (SELECT {_table_no(d)} AS tno, CAST(sum(p_size) AS BIGINT) AS size
          FROM {d.table('part')} GROUP BY 1) g"""


def constraints(d) -> str:
    t = "tno"
    return f"""
    SELECT concat('s', {d.text(f'{t} % 4')}) AS server,
      CASE WHEN {t} % 9 = 8 THEN 'sys' ELSE 'shop' END AS schema, concat('t', {d.text(t)}) AS table_,
      CASE WHEN {t} % 3 = 0 THEN 'UNIQUE' ELSE 'PRIMARY KEY' END AS constraint_type
    FROM (SELECT DISTINCT {_table_no(d)} AS tno FROM {d.table('part')}) g"""


def catalog_columns(d) -> str:
    return f"""
    SELECT concat('s', {d.text(f'{_table_no(d)} % 4')}) AS server, 'shop' AS schema,
      concat('t', {d.text(_table_no(d))}) AS table_, concat('col_', {d.text('p_partkey')}) AS column_,
      CASE p_size % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(20)' ELSE 'double' END AS column_type,
      CASE WHEN p_size % 2 = 0 THEN 'YES' ELSE 'no' END AS is_nullable,
      CASE WHEN p_partkey % 8 < p_size % 3 THEN 'PRI' ELSE '' END AS column_key,
      CASE WHEN p_partkey % 8 = 0 THEN 'auto_increment' END AS extra,
      CAST(p_partkey % 8 + 1 AS INT) AS ordinal
    FROM {d.table('part')}"""


def reports(d) -> str:
    """Engine reports, one per order: both layouts, some with a deadlock."""
    k, nl = "o_orderkey", ("'\\n'" if isinstance(d, Spark) else "chr(10)")
    rule = "'------------------------'"

    def lines(*parts: str) -> str:
        return "concat(" + f", {nl}, ".join(parts) + f", {nl})"

    def label(text: str, e: str) -> str:
        return f"concat('{text}', {d.text(e)})"

    def lock(index: str, table: str, key: str, mode: str) -> str:
        place = f"'RECORD LOCKS space id ', {d.text(f'{key} % 800 + 3')}, ' page no ', {d.text(f'{key} % 61 + 5')}, ' n bits ', {d.text(f'{key} % 4 * 8 + 72')}"
        return f"concat({place}, ' index {index} of table {table} trx id ', {d.text(key)}, ' {mode}')"

    def statement(n: int, key: str) -> list[str]:
        """The two sides run different statements."""
        if n == 1:
            return [f"concat('DELETE FROM `depot`.`pallet` WHERE lane = ', {d.text(key)})", f"concat('  ORDER BY slot LIMIT ', {d.text('o_custkey')})"]
        return [f"concat('UPDATE `depot`.`bay` SET lane = NULL WHERE slot > ', {d.text(key)}, ' AND crane = ', {d.text('o_custkey')})"]

    def party(n: int, key: str) -> list[str]:
        return [
            f"'*** ({n}) TRANSACTION:'",
            f"concat('TRANSACTION ', {d.text(key)}, ', ACTIVE ', {d.text(f'{key} % 60')}, ' sec fetching rows')",
            f"concat('mysql tables in use ', {d.text(f'{key} % 3 + 1')}, ', locked ', {d.text(f'{key} % 2 + 1')})",
            f"concat('LOCK WAIT ', {d.text(f'{key} % 9 + 2')}, ' lock struct(s), heap size ', {d.text(f'{key} % 7 * 1024 + 3200')}, ', ', {d.text(f'{key} % 5')}, ' row lock(s)')",
            f"concat('MySQL thread id ', {d.text(f'{key} + 7')}, ', OS thread handle ', {d.text(f'{key} + 140000')}, ', query id ', {d.text(f'{key} * 2')}, ' 172.20.4.', {d.text('o_custkey % 9')}, ' svc', {d.text(f'{key} % 3')}, ' Searching rows for update')",
            *statement(n, key),
            f"'*** ({n}) HOLDS THE LOCK(S):'",
            lock("by_bay", "`depot`.`', o_orderpriority, '`", key, "lock mode S"),
            f"'*** ({n}) WAITING FOR THIS LOCK TO BE GRANTED:'",
            lock("by_lane", "`depot`.`pallet`", key, "lock_mode X locks gap before rec waiting"),
        ]

    deadlock = lines(
        rule, "'LATEST DETECTED DEADLOCK'", rule,
        f"concat('2031-02-14 22:41:', {d.text(f'{k} % 50 + 10')})",
        *party(1, k), *party(2, f"({k} + 1)"),
        f"concat('*** WE ROLL BACK TRANSACTION (', {d.text(f'{k} % 2 + 1')}, ')')",
    )
    log = lines(
        "'------------'", "'TRANSACTIONS'", "'------------'", label("Trx id counter ", f"{k} + 90817"),
        label("History list length ", f"{k} * 97 % 2000000"),
        "'---'", "'LOG'", "'---'",
        label("Log sequence number ", f"91250000000 + {k}"),
        label("Log buffer assigned up to ", f"91250000000 + {k}"),
        label("Log flushed up to   ", f"91250000000 + {k} - {k} % 700"),
        label("Pages flushed up to ", "91240000000"),
        label("Last checkpoint at  ", f"91250000000 + {k} - {k} * 157 % 2100000"),
        "'BUFFER POOL AND MEMORY'",
        label("Buffer pool size   ", f"CASE WHEN {k} % 5 = 0 THEN 0 ELSE 40960 END"),
        label("Free buffers       ", f"{k} % 3001"),
        label("Database pages     ", f"{k} % 36000"),
        label("Modified db pages  ", f"{k} % 450"),
        "'Buffer pool size   2560'",
    )
    return f"""
    SELECT concat('s', {d.text('o_custkey')}) AS server, {d.seconds_ts(f'{_NOW} + {k}')} AS snapshot_ts,
      {k} AS id, o_custkey, o_orderpriority,
      concat('=====', {nl}, 'INNODB MONITOR OUTPUT', {nl},
        'OS WAIT ARRAY INFO: reservation count ', {d.text(f'{k} % 9000')}, {nl},
        CASE WHEN o_orderstatus = 'P' THEN {deadlock} ELSE '' END, {log}) AS report
    FROM {d.table('orders')}"""


def replicas_new(d) -> str:
    return _replicas(d, "Source", "Replica", "s_suppkey % 2 = 0")


def replicas_old(d) -> str:
    return _replicas(d, "Master", "Slave", "s_suppkey % 2 = 1")


def _replicas(d, source: str, replica: str, part: str) -> str:
    k = "s_suppkey"
    return f"""
    SELECT concat('s', {d.text(f'{k} % 40')}) AS server, concat('ch', {d.text(k)}) AS Channel_Name,
      'db1' AS {source}_Host, '3306' AS {source}_Port, 'repl' AS {source}_User,
      CASE {k} % 7 WHEN 0 THEN 'No' WHEN 1 THEN 'Connecting' ELSE 'Yes' END AS {replica}_IO_Running,
      CASE {k} % 5 WHEN 0 THEN 'NO' ELSE 'yes' END AS {replica}_SQL_Running,
      CASE WHEN {k} % 8 = 0 THEN NULL ELSE {d.text(f'{k} % 8 * {k} % 330')} END AS Seconds_Behind_{source},
      concat('bin.', {d.text(f'{k} % 3')}) AS {source}_Log_File,
      {d.text(f'10000 + {k} * 10')} AS Read_{source}_Log_Pos,
      CASE WHEN {k} % 6 = 0 THEN '' ELSE concat('bin.', {d.text(f'{k} % 6')}) END AS Relay_{source}_Log_File,
      {d.text(f'10400 + {k} * 8')} AS Exec_{source}_Log_Pos, ' 512 ' AS Relay_Log_Space,
      CASE {k} % 11 WHEN 0 THEN '2003' WHEN 1 THEN '' ELSE '0' END AS Last_IO_Errno,
      CASE {k} % 11 WHEN 0 THEN 'no route' WHEN 1 THEN 'retrying' ELSE '' END AS Last_IO_Error,
      CASE WHEN {k} % 13 = 0 THEN '1062' ELSE '0' END AS Last_SQL_Errno,
      CASE WHEN {k} % 13 = 0 THEN 'duplicate' END AS Last_SQL_Error,
      'waiting' AS {replica}_SQL_Running_State,
      CASE WHEN {k} % 4 = 0 THEN '3600' ELSE '0' END AS SQL_Delay
    FROM {d.table('supplier')} WHERE {part}"""


def statements(d) -> str:
    """Statements with comments in front, around the text of conversations."""
    nl = "'\\n'" if isinstance(d, Spark) else "chr(10)"
    return f"""
    SELECT conv_id, turn, concat(
      CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN concat('-- note', {nl}) WHEN 2 THEN '/* drop */ '
        ELSE concat('# x', {nl}, '  (') END,
      CASE conv_id % 9 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN 'insert into t values (1)' WHEN 2 THEN 'Drop table t'
        WHEN 3 THEN 'WITH a AS (SELECT 1) SELECT * FROM a' WHEN 4 THEN 'frobnicate' WHEN 5 THEN 'TRUNCATE t'
        WHEN 6 THEN 'kill 5' WHEN 7 THEN 'show tables' ELSE '' END, ' ', text) AS sql
    FROM {d.table('conversations')}"""


def grid(d) -> str:
    """Documents as a text grid with NULLs, empty cells and edge blanks."""
    return f"""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', lang) ELSE lang END AS lang,
      source, n_chars,
      CASE WHEN doc_id % 7 = 0 THEN concat('a|b', chr(92), 'c "', source, '" <i>&''', lang, '''</i>') ELSE text END AS text
    FROM {d.table('documents')}"""


ALL = {
    f.__name__: f
    for f in (
        metrics, status_wide, status, servers, variables, processlist, trx, lock_waits, locks_new,
        locks_old, metadata_locks, digests, digests_raw, samples_raw, index_columns, workload_indexes, index_usage,
        tables, constraints, catalog_columns, reports, replicas_new, replicas_old, statements, grid,
    )
}

# Column names that are reserved words somewhere.
RENAMES = {"table_": "table", "index_": "index", "column_": "column"}


def base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = ALL[name](Spark())
    used = {t: base(spark, folder, t) for t in BASE_TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql, **used)
    for old, new in RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def with_views(*names: str) -> str:
    """``WITH v_a AS (...), v_b AS (...)`` in ANSI SQL."""
    return "WITH " + ", ".join(f"v_{n} AS ({ALL[n](Ansi())})" for n in names)
