"""Queries over the snapshot readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators.replication import coalesce_aliases
from tidewatch.plans.registry import query
from tidewatch.plans.views import view, with_views
from tidewatch.sources import snapshots as S
from tidewatch.sources.capabilities import FLAGS, SINCE, SINCE_MARIADB, capability_summary, server_capabilities
from tidewatch.sources.schemas import DIGESTS_RAW, STATEMENT_SAMPLES_RAW


@query(
    "read_status",
    with_views("status")
    + """ SELECT server, session, t, variable, value_raw,
      CASE WHEN regexp_full_match(value_raw, '\\+?[0-9]+') THEN TRY_CAST(value_raw AS BIGINT) END AS value
    FROM v_status""",
)
def _(spark, sf):
    return S.read_status(view(spark, sf, "status")).select(
        "server", "session", "t", "variable", "value_raw", F.col("value").cast("bigint").alias("value")
    )


SETTINGS = [
    "max_connections", "wait_timeout", "interactive_timeout", "innodb_buffer_pool_size", "innodb_buffer_pool_instances",
    "innodb_redo_log_capacity", "innodb_log_file_size", "innodb_log_files_in_group", "innodb_io_capacity",
    "innodb_io_capacity_max", "innodb_flush_log_at_trx_commit", "innodb_max_dirty_pages_pct", "innodb_page_size",
]


@query(
    "read_variables",
    with_views("variables")
    + " SELECT server, "
    + ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in SETTINGS)
    + f" FROM v_variables WHERE name IN ({', '.join(map(repr, SETTINGS))}) GROUP BY server",
)
def _(spark, sf):
    return S.read_variables(view(spark, sf, "variables"), SETTINGS)


@query(
    "read_server_limits",
    with_views("variables")
    + """ SELECT server,
      coalesce(max(TRY_CAST(value AS BIGINT)) FILTER (name = 'max_connections'), 0) AS max_connections,
      coalesce(max(TRY_CAST(value AS BIGINT)) FILTER (name = 'wait_timeout'), 0) AS wait_timeout,
      coalesce(max(TRY_CAST(value AS BIGINT)) FILTER (name = 'interactive_timeout'), 0) AS interactive_timeout
    FROM v_variables GROUP BY server""",
)
def _(spark, sf):
    limits = S.read_server_limits(view(spark, sf, "variables"))
    return limits.select("server", *[F.col(c).cast("bigint").alias(c) for c in limits.columns[1:]])


@query(
    "read_processlist",
    with_views("processlist")
    + """ SELECT server, id, user, host, db, command, time, state, coalesce(info, '') AS info
    FROM v_processlist WHERE id <> 5""",
)
def _(spark, sf):
    rows = view(spark, sf, "processlist")
    # As from two tables, each with its statements; an odd id below zero leaves -1.
    even, odd = rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")
    return S.read_processlist(even, odd, own_id=5).drop("snapshot_ts")


@query(
    "read_digests",
    with_views("digests_raw")
    + """ SELECT server, coalesce(digest, '') AS digest, coalesce(schema_name, '') AS schema,
      coalesce(query_sample_text, digest_text) AS text, count_star AS "count",
      sum_timer_wait / 1e9 AS total_ms, 0.0::DOUBLE AS avg_ms, max_timer_wait / 1e9 AS max_ms
    FROM v_digests_raw""",
)
def _(spark, sf):
    raw = S.conform(view(spark, sf, "digests_raw"), DIGESTS_RAW)
    return S.read_digests(raw).select(
        "server", "digest", "schema", "text", "count", "total_ms", "avg_ms", "max_ms"
    )


@query(
    "read_statement_samples",
    with_views("samples_raw")
    + """ SELECT server, digest, timer_start, sql_text AS sql, timer_wait / 1e9 AS ms, rows_examined,
      rows_sent, no_index_used <> 0 AS no_index_used, no_good_index_used <> 0 AS no_good_index_used,
      coalesce(errors, 0) AS errors
    FROM v_samples_raw QUALIFY row_number() OVER
      (PARTITION BY server, digest ORDER BY timer_start DESC, sql_text) <= 20""",
)
def _(spark, sf):
    raw = S.conform(view(spark, sf, "samples_raw"), STATEMENT_SAMPLES_RAW)
    return S.read_statement_samples(raw).drop("lock_ms", "tmp_disk_tables")


@query(
    "read_transactions",
    with_views("trx")
    + """ SELECT server, trx_id, state, started AS started_s, coalesce(snapshot_ts - wait_started, 0) AS wait_secs,
      coalesce(thread_id, 0) AS thread_id, rows_locked, rows_modified,
      coalesce(isolation, '') AS isolation, coalesce(query, '') AS query
    FROM v_trx""",
)
def _(spark, sf):
    rows = S.read_transactions(view(spark, sf, "trx"))
    return rows.withColumn("started_s", F.unix_seconds("started")).drop("snapshot_ts", "started")


@query(
    "read_engine_reports",
    with_views("reports")
    + " SELECT server, snapshot_ts AS snapshot_s, md5(report) AS digest, length(report) AS n FROM v_reports",
)
def _(spark, sf):
    rows = S.read_engine_reports(view(spark, sf, "reports"))
    return rows.select(
        "server",
        F.unix_seconds("snapshot_ts").alias("snapshot_s"),
        F.md5("report").alias("digest"),
        F.length("report").cast("bigint").alias("n"),
    )


@query(
    "read_replica_status",
    with_views("replicas_new", "replicas_old")
    + """ SELECT Channel_Name AS channel, Replica_IO_Running AS io_running,
      Seconds_Behind_Source AS seconds_behind FROM v_replicas_new
    UNION ALL SELECT Channel_Name, Slave_IO_Running, Seconds_Behind_Master FROM v_replicas_old""",
)
def _(spark, sf):
    rows = S.read_replica_status(view(spark, sf, "replicas_new"), view(spark, sf, "replicas_old"))
    return rows.select(
        F.col("Channel_Name").alias("channel"),
        coalesce_aliases(rows, ["Replica_IO_Running", "Slave_IO_Running"]).alias("io_running"),
        coalesce_aliases(rows, ["Seconds_Behind_Source", "Seconds_Behind_Master"]).alias("seconds_behind"),
    )


@query(
    "read_connected_replicas",
    with_views("replicas_new", "replicas_old")
    + """ SELECT server, row_number() OVER (PARTITION BY server ORDER BY ch) AS replica_id, ch AS host, 3306 AS port, 'new' AS uuid,
      CAST(substr(server, 2) AS BIGINT) AS source_id FROM (SELECT server, Channel_Name AS ch FROM v_replicas_new) x
    UNION ALL SELECT server, NULL, ch, NULL, '', CAST(substr(server, 2) AS BIGINT) FROM (SELECT server, Channel_Name AS ch FROM v_replicas_old) y""",
)
def _(spark, sf):
    """Lists of both generations, made of the channels: the older servers report no usable id or port."""
    number = F.row_number().over(Window.partitionBy("server").orderBy("Channel_Name"))
    source = F.substring("server", 2, 20)
    new = view(spark, sf, "replicas_new").select(
        "server", number.alias("Server_Id"), F.col("Channel_Name").alias("Host"), F.lit("3306").alias("Port"),
        source.alias("Source_Id"), F.lit("new").alias("Replica_UUID"),
    )
    old = view(spark, sf, "replicas_old").select(
        "server", F.lit("none").alias("Server_id"), F.col("Channel_Name").alias("Host"), F.lit("").alias("Port"), source.alias("Master_id"),
    )
    return S.read_connected_replicas(new, old)


@query(
    "latest_snapshot",
    with_views("processlist")
    + """ SELECT server, id, user, time FROM v_processlist
    QUALIFY rank() OVER (PARTITION BY server ORDER BY snapshot_ts DESC) = 1""",
)
def _(spark, sf):
    return S.latest_snapshot(view(spark, sf, "processlist")).select("server", "id", "user", "time")


FLAGGED = (
    with_views("servers")
    + r""", nums AS (
      SELECT *, string_split(regexp_extract(version, '^[0-9.]*'), '.') AS p FROM v_servers),
    parsed AS (SELECT server, version, coalesce(TRY_CAST(p[1] AS INT), 0) AS major,
        coalesce(TRY_CAST(p[2] AS INT), 0) AS minor, coalesce(TRY_CAST(p[3] AS INT), 0) AS patch,
        lower(version || ' ' || version_comment) AS hay FROM nums),
    flavored AS (SELECT *, major * 1000000 + minor * 1000 + patch AS v,
        CASE WHEN contains(hay, 'mariadb') THEN 'MariaDB' WHEN contains(hay, 'percona') THEN 'Percona'
          WHEN major > 0 THEN 'MySQL' ELSE 'Unknown' END AS flavor FROM parsed),
    flagged AS (SELECT *, """
    + ", ".join(
        "CASE WHEN flavor = 'MariaDB' THEN {m} ELSE {o} END AS {f}".format(
            f=f,
            m="false" if SINCE_MARIADB[f] is None else "v >= %d" % (SINCE_MARIADB[f][0] * 1000000 + SINCE_MARIADB[f][1] * 1000 + SINCE_MARIADB[f][2]),
            o="false" if SINCE[f] is None else "v >= %d" % (SINCE[f][0] * 1000000 + SINCE[f][1] * 1000 + SINCE[f][2]),
        )
        for f in FLAGS
    )
    + " FROM flavored)"
)


@query(
    "server_capabilities",
    FLAGGED + f" SELECT server, major, minor, patch, flavor, {', '.join(FLAGS)} FROM flagged",
)
def _(spark, sf):
    caps = server_capabilities(view(spark, sf, "servers"))
    return caps.select("server", "major", "minor", "patch", "flavor", *FLAGS)


@query(
    "capability_summary",
    FLAGGED
    + """ SELECT server, array_to_string(list_filter([
        CASE WHEN perf_schema_on THEN 'perf_schema' END, CASE WHEN ps_processlist THEN 'ps.processlist' END,
        CASE WHEN ps_data_locks THEN 'data_locks' ELSE 'innodb_locks' END,
        CASE WHEN statement_digest THEN 'digest' END, CASE WHEN sys_schema THEN 'sys' END],
        lambda x: x IS NOT NULL), ' · ') AS summary FROM flagged""",
)
def _(spark, sf):
    return server_capabilities(view(spark, sf, "servers")).select(
        "server", capability_summary().alias("summary")
    )
