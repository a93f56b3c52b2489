"""Queries over counters, rates and the metric store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import rates as R
from tidewatch.operators import series as P
from tidewatch.operators.alerts import alert_states, evaluate_alerts, firing_counts
from tidewatch.operators.locks import lock_wait_summary
from tidewatch.plans.dashboard import SHOWN, dashboard_cards
from tidewatch.plans.registry import query
from tidewatch.plans.views import view, with_views
from tidewatch.plans.workspace import folder_bytes, workspace
from tidewatch.sources.snapshots import read_server_limits, read_status


def status(spark, sf):
    return read_status(view(spark, sf, "status"))


def limits(spark, sf):
    return read_server_limits(view(spark, sf, "variables"))


# Counters next to the sample before them.
NUMERIC = (
    with_views("status")
    + r""", num AS (SELECT server, session, t, wall_ms, variable, value_raw,
        CASE WHEN regexp_full_match(value_raw, '\+?[0-9]+') THEN TRY_CAST(value_raw AS BIGINT) END AS value
      FROM v_status)"""
)
_PREV = """ SELECT server, session, t, variable, value, t - lag(t) OVER w AS dt, lag(value) OVER w AS prev
      FROM num WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY server, session, variable ORDER BY t)"""
DELTAS = (
    NUMERIC
    + f""", d AS ({_PREV}),
    deltas AS (SELECT server, session, t, variable, value, dt,
      CAST(CASE WHEN value >= prev THEN value - prev ELSE 0 END AS DOUBLE) AS delta FROM d WHERE dt IS NOT NULL)"""
)


@query("counter_deltas", DELTAS + " SELECT * FROM deltas")
def _(spark, sf):
    out = R.counter_deltas(status(spark, sf))
    return out.withColumn("value", F.col("value").cast("bigint")).drop("wall_ms")


@query("counter_rates", DELTAS + " SELECT server, session, t, variable, CASE WHEN dt > 0 THEN delta / dt ELSE 0 END AS rate FROM deltas")
def _(spark, sf):
    return R.counter_rates(status(spark, sf)).select("server", "session", "t", "variable", "rate")


def _d(name: str) -> str:
    return f"CASE WHEN {name} >= lag({name}) OVER w THEN CAST({name} - lag({name}) OVER w AS DOUBLE) ELSE 0 END"


_WIDE = (
    NUMERIC
    + ", wide AS (SELECT server, session, t, wall_ms, "
    + ", ".join(f"max(value) FILTER (variable = '{n}') AS {n}" for n in R.COUNTERS + R.GAUGES)
    + " FROM num GROUP BY ALL), grown AS (SELECT server, session, t, wall_ms, t - lag(t) OVER w AS dt, "
    + ", ".join(f"{_d(n)} AS d_{n}" for n in R.COUNTERS)
    + ", Handler_commit, CAST(Threads_connected AS DOUBLE) AS conn, CAST(Threads_running AS DOUBLE) AS running"
    + " FROM wide WINDOW w AS (PARTITION BY server, session ORDER BY t))"
)
_LIMITS = """, lim AS (SELECT server AS ls, max(TRY_CAST(value AS BIGINT)) FILTER (name = 'max_connections') AS mc
      FROM v_variables GROUP BY server)"""
DERIVED = (
    _WIDE.replace("WITH ", with_views("variables") + ", ", 1)
    + _LIMITS
    + """, derived AS (SELECT server, session, t, wall_ms, d_Queries / dt AS qps,
      CASE WHEN Handler_commit IS NOT NULL THEN (d_Handler_commit + d_Handler_rollback) / dt
        ELSE (d_Com_commit + d_Com_rollback) / dt END AS tps,
      d_Slow_queries / dt AS slow_qps, coalesce(running, 0) AS threads_running,
      coalesce(conn, 0) AS threads_connected,
      CASE WHEN d_Innodb_buffer_pool_read_requests > 0 THEN greatest(0.0, least(1.0,
        1.0 - d_Innodb_buffer_pool_reads / d_Innodb_buffer_pool_read_requests)) ELSE 1.0 END AS bp_hit_ratio,
      d_Bytes_received / dt AS bytes_in_s, d_Bytes_sent / dt AS bytes_out_s,
      d_Innodb_rows_read / dt AS rows_read_s,
      (d_Innodb_rows_inserted + d_Innodb_rows_updated + d_Innodb_rows_deleted) / dt AS rows_written_s,
      d_Created_tmp_disk_tables / dt AS tmp_disk_tables_s, d_Table_locks_waited / dt AS table_lock_waits_s,
      d_Aborted_connects / dt AS aborted_connects_s,
      CASE WHEN coalesce(mc, 0) > 0 THEN coalesce(conn, 0) / mc * 100.0 ELSE 0.0 END AS conn_usage_pct
    FROM grown LEFT JOIN lim ON ls = server WHERE dt > 0)"""
)


def derived(spark, sf):
    return R.derive_metrics(status(spark, sf), limits(spark, sf))


@query("derive_metrics", DERIVED + " SELECT * FROM derived")
def _(spark, sf):
    return derived(spark, sf)


@query("hit_ratio", DERIVED + " SELECT server, session, t, bp_hit_ratio FROM derived")
def _(spark, sf):
    return derived(spark, sf).select("server", "session", "t", "bp_hit_ratio")


@query("tps_with_fallback", DERIVED + " SELECT server, session, t, tps FROM derived")
def _(spark, sf):
    return derived(spark, sf).select("server", "session", "t", "tps")


@query("conn_usage_pct", DERIVED + " SELECT server, session, t, conn_usage_pct FROM derived")
def _(spark, sf):
    return derived(spark, sf).select("server", "session", "t", "conn_usage_pct")


_LONG = (
    DERIVED
    + ", pct AS (SELECT *, bp_hit_ratio * 100.0 AS bp_hit_pct FROM derived)"
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT server, session, t, wall_ms, '{k}' AS metric, CAST({k} AS DOUBLE) AS value FROM pct" for k in R.METRIC_KEYS
    )
    + ")"
)


@query("metrics_long", _LONG + " SELECT server, session, t, metric, value FROM long")
def _(spark, sf):
    return R.metrics_long(derived(spark, sf)).drop("wall_ms")


@query(
    "raw_status_delta",
    NUMERIC
    + """, p AS (SELECT *, t - lag(t) OVER w AS dt, lag(value) OVER w AS prev FROM num
      WINDOW w AS (PARTITION BY server, session, variable ORDER BY t))
    SELECT server, session, t, variable, value_raw,
      CASE WHEN dt > 0 AND value >= prev THEN CAST(value - prev AS DOUBLE) / dt END AS per_s FROM p""",
)
def _(spark, sf):
    return R.raw_status_delta(status(spark, sf)).drop("wall_ms")


@query(
    "live_tail",
    with_views("metrics")
    + """ SELECT server, metric, ts, value FROM v_metrics
    QUALIFY row_number() OVER (PARTITION BY server, metric ORDER BY ts DESC, seq DESC) <= 900""",
)
def _(spark, sf):
    m = metrics(spark, sf).withColumns({"t": F.col("ts"), "wall_ms": F.col("seq")})
    return R.live_tail(m).select("server", "metric", "ts", "value")


def metrics(spark, sf):
    return view(spark, sf, "metrics")


@query(
    "dashboard_cards",
    _LONG.replace("WITH ", with_views("lock_waits", "trx") + ", ", 1)
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY t DESC) AS n FROM derived),
    blocked AS (SELECT w.server, greatest(coalesce(r.snapshot_ts - r.wait_started, 0), 0) AS secs FROM v_lock_waits w
      JOIN v_trx r ON r.server = w.server AND r.trx_id = w.requesting_trx
      JOIN v_trx b ON b.server = w.server AND b.trx_id = w.blocking_trx),
    waits AS (SELECT server, count(*) AS n, max(secs) AS longest FROM blocked GROUP BY server),
    rule(rule_id, rm, above, th, hold) AS (VALUES (1, 'conn_usage_pct', true, 80.0, 30.0),
      (2, 'threads_running', true, 40.0, 15.0), (3, 'slow_qps', true, 5.0, 30.0),
      (4, 'bp_hit_pct', false, 95.0, 60.0), (5, 'table_lock_waits_s', true, 1.0, 30.0),
      (6, 'tmp_disk_tables_s', true, 5.0, 60.0), (7, 'aborted_connects_s', true, 1.0, 30.0)),
    flag AS (SELECT server, session, rule_id, t, hold, CASE WHEN above THEN value > th ELSE value < th END AS b
      FROM long JOIN rule ON rm = metric),
    turn AS (SELECT *, CASE WHEN b <> lag(b, 1, false) OVER w THEN t END AS turned FROM flag
      WINDOW w AS (PARTITION BY server, session, rule_id ORDER BY t)),
    run AS (SELECT *, max(turned) OVER (PARTITION BY server, session, rule_id ORDER BY t) AS since FROM turn),
    last AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY server, session, rule_id ORDER BY t DESC) = 1),
    fire AS (SELECT server, count(*) AS firing FROM last WHERE b AND t - since >= hold GROUP BY server)
    SELECT r.server, """
    + ", ".join(f"r.{c}" for c in SHOWN)
    + """, threads_running > 40 AS running_high, slow_qps > 1 AS slow_high, bp_hit_ratio < 0.95 AS hit_low,
      coalesce(w.n, 0) AS lock_waits, coalesce(w.longest, 0) AS longest_wait_secs, coalesce(f.firing, 0) AS firing
    FROM ranked r LEFT JOIN waits w ON w.server = r.server LEFT JOIN fire f ON f.server = r.server WHERE r.n = 1""",
)
def _(spark, sf):
    from tidewatch.plans.queries_ops import waits

    wide = derived(spark, sf)
    states = alert_states(evaluate_alerts(R.metrics_long(wide)))
    return dashboard_cards(wide, lock_wait_summary(waits(spark, sf)), firing_counts(states))


# ------------------------------------------------------------- the store

T0, DAY = 1704067200000, 86_400_000  # start of the events, one day in ms
NOW = T0 + 29 * DAY + 12 * 3_600_000 + 30_500


def samples(spark, sf):
    return metrics(spark, sf).select("server", "metric", "ts", "value", "seq")


def folded(spark, sf):
    """Rollups of the first twenty days, for all metrics but one."""
    return P.rollup_1m(samples(spark, sf).where((F.col("ts") < T0 + 20 * DAY) & (F.col("metric") != "slow_qps")))


_FOLD = """, fold AS (SELECT server, metric, ts // 60000 * 60000 AS ts, avg(value) AS avg, min(value) AS min,
      max(value) AS max FROM v_metrics {w} GROUP BY ALL)"""
_FOLDED = _FOLD.format(w=f"WHERE ts < {T0 + 20 * DAY} AND metric <> 'slow_qps'")


@query(
    "upsert_samples",
    with_views("metrics")
    + """ SELECT server, metric, ts // 60000 * 60000 AS ts, arg_max(value, seq) AS value FROM v_metrics GROUP BY ALL""",
)
def _(spark, sf):
    coarse = samples(spark, sf).withColumn("ts", P.bucket_start(F.col("ts"), 60_000))
    return P.upsert_samples(coarse)


@query("rollup_1m", with_views("metrics") + _FOLD.format(w=f"WHERE ts < {(NOW - 60000) // 60000 * 60000}") + " SELECT * FROM fold")
def _(spark, sf):
    return P.rollup_1m(samples(spark, sf), now_ms=NOW)


@query(
    "apply_retention",
    with_views("metrics")
    + _FOLD.format(w="")
    + f""" SELECT 'raw' AS kind, server, metric, ts, value FROM v_metrics WHERE ts >= {(NOW - P.RAW_RETENTION_MS) // 60000 * 60000}
    UNION ALL SELECT 'rollup', server, metric, ts, avg FROM fold WHERE ts >= {(NOW - P.ROLLUP_RETENTION_MS) // 60000 * 60000}""",
)
def _(spark, sf):
    raw = samples(spark, sf)
    kept, rolled = P.apply_retention(raw, P.rollup_1m(raw), NOW)
    return kept.select(F.lit("raw").alias("kind"), "server", "metric", "ts", "value").unionByName(
        rolled.select(F.lit("rollup").alias("kind"), "server", "metric", "ts", F.col("avg").alias("value"))
    )


_SHORT = P.RangeSpec(T0 + 5 * DAY, T0 + 5 * DAY + 5 * 3_600_000)


@query(
    "read_series_short",
    with_views("metrics")
    + f""" SELECT server, metric, ts // {_SHORT.bucket_ms} * {_SHORT.bucket_ms} AS ts, avg(value) AS value,
      min(value) AS min, max(value) AS max, false AS downsampled
    FROM v_metrics WHERE ts BETWEEN {_SHORT.from_ms} AND {_SHORT.to_ms} GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return P.read_series(samples(spark, sf), folded(spark, sf), _SHORT.from_ms, _SHORT.to_ms)


_LONG_RANGE = P.RangeSpec(T0 + 3 * DAY, T0 + 24 * DAY)
_SERIES = f""", b AS (SELECT server, metric, ts // {_LONG_RANGE.bucket_ms} * {_LONG_RANGE.bucket_ms} AS ts,
      avg(avg) AS value, min(min) AS min, max(max) AS max, true AS downsampled
      FROM fold WHERE ts BETWEEN {_LONG_RANGE.from_ms} AND {_LONG_RANGE.to_ms} GROUP BY 1, 2, 3),
    r AS (SELECT server, metric, ts // {_LONG_RANGE.bucket_ms} * {_LONG_RANGE.bucket_ms} AS ts,
      avg(value) AS value, min(value) AS min, max(value) AS max, false AS downsampled
      FROM v_metrics WHERE ts BETWEEN {_LONG_RANGE.from_ms} AND {_LONG_RANGE.to_ms} GROUP BY 1, 2, 3)
    SELECT * FROM b UNION ALL SELECT * FROM r
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.server = r.server AND b.metric = r.metric)"""


@query("read_series", with_views("metrics") + _FOLDED + _SERIES)
def _(spark, sf):
    return P.read_series(samples(spark, sf), folded(spark, sf), _LONG_RANGE.from_ms, _LONG_RANGE.to_ms)


@query("read_series_fallback", with_views("metrics") + _FOLDED + _SERIES.replace("SELECT * FROM b UNION ALL ", ""))
def _(spark, sf):
    out = P.read_series(samples(spark, sf), folded(spark, sf), _LONG_RANGE.from_ms, _LONG_RANGE.to_ms)
    return out.where(~F.col("downsampled"))


@query(
    "split_bytes_rates",
    with_views("metrics") + " SELECT server, metric, ts, value, metric IN ('bytes_in_s', 'bytes_out_s') AS is_bytes FROM v_metrics",
)
def _(spark, sf):
    byte_rates, others = P.split_bytes_rates(samples(spark, sf).drop("seq"))
    return byte_rates.withColumn("is_bytes", F.lit(True)).unionByName(others.withColumn("is_bytes", F.lit(False)))


@query(
    "store_stats",
    with_views("metrics")
    + _FOLDED
    + """ SELECT (SELECT count(*) FROM v_metrics) AS raw_rows, (SELECT count(*) FROM fold) AS rollup_rows,
      least((SELECT min(ts) FROM v_metrics), (SELECT min(ts) FROM fold)) AS oldest_ms, true AS size_is_that_of_the_files""",
)
def _(spark, sf):
    """Both tables as files of a store; their size must be what the file system says."""
    home = workspace(spark)
    tables = [(samples(spark, sf), f"{home}/raw"), (folded(spark, sf), f"{home}/rollup")]
    read = []
    for df, path in tables:
        df.write.parquet(path)
        read.append(spark.read.schema(df.schema).parquet(path))
    stats = P.store_stats(*read, paths=[path for _, path in tables])
    size = sum(folder_bytes(spark, path) for _, path in tables)
    return stats.withColumn("size_is_that_of_the_files", F.col("stored_bytes") == size).drop("stored_bytes")


@query(
    "export_metrics_csv",
    with_views("metrics")
    + f""" SELECT concat_ws(',', ts, server, metric, CAST(value AS BIGINT)) AS line FROM v_metrics
    WHERE ts BETWEEN {_SHORT.from_ms} AND {_SHORT.to_ms}
    UNION ALL SELECT 'timestamp_ms,server,metric,value'""",
)
def _(spark, sf):
    out = P.export_metrics_csv(samples(spark, sf), folded(spark, sf), _SHORT.from_ms, _SHORT.to_ms)
    return out.select("line")
