"""Counter samples to per-second rates and the fourteen-metric row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import matches_needle, usage_pct
from tidewatch.operators.timeline import DAY_SECONDS, chunk_of, look_back

LIVE_POINTS = 900  # fixed value: points kept per live series

# Metric key, label, byte rate or not. Keys are storage names.
METRICS = [
    ("qps", "Queries/s", False),
    ("tps", "Transactions/s", False),
    ("slow_qps", "Slow queries/s", False),
    ("threads_running", "Threads running", False),
    ("threads_connected", "Threads connected", False),
    ("bp_hit_pct", "Buffer pool hit %", False),
    ("bytes_in_s", "Network in", True),
    ("bytes_out_s", "Network out", True),
    ("rows_read_s", "InnoDB rows read/s", False),
    ("rows_written_s", "InnoDB rows written/s", False),
    ("tmp_disk_tables_s", "Tmp disk tables/s", False),
    ("table_lock_waits_s", "Table lock waits/s", False),
    ("aborted_connects_s", "Aborted connects/s", False),
    ("conn_usage_pct", "Connection usage %", False),
]
METRIC_KEYS = [key for key, _, _ in METRICS]
METRIC_LABELS = {key: label for key, label, _ in METRICS}
BYTE_METRICS = [key for key, _, is_bytes in METRICS if is_bytes]

# Server counters behind the metrics.
COUNTERS = [
    "Queries", "Slow_queries", "Handler_commit", "Handler_rollback", "Com_commit", "Com_rollback",
    "Bytes_received", "Bytes_sent", "Innodb_rows_read", "Innodb_rows_inserted",
    "Innodb_rows_updated", "Innodb_rows_deleted", "Innodb_buffer_pool_reads",
    "Innodb_buffer_pool_read_requests", "Table_locks_waited", "Aborted_connects",
    "Created_tmp_disk_tables",
]
GAUGES = ["Threads_connected", "Threads_running"]

SAMPLE_KEYS = ["server", "session", "t", "wall_ms"]


def delta(prev: Column, cur: Column) -> Column:
    """Counter growth as DOUBLE. A reset, or an unknown side, counts as none."""
    return F.when(cur >= prev, (cur - prev).cast("double")).otherwise(F.lit(0.0))


def per_second(amount: Column, dt: Column) -> Column:
    return F.when(dt > 0, amount / dt).otherwise(F.lit(0.0))


def hit_ratio(reads: Column, requests: Column) -> Column:
    """Share of page requests served from memory; an idle pool counts as 1."""
    ratio = F.lit(1.0) - reads / requests
    return F.when(
        requests > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    ).otherwise(F.lit(1.0))


def _with_previous(status: DataFrame, chunk_seconds: float) -> DataFrame:
    return look_back(
        status,
        keys=["server", "session", "variable"],
        order=["t", "wall_ms"],
        chunk=chunk_of(F.col("t"), chunk_seconds),
        previous={"prev_t": F.col("t"), "prev_value": F.col("value")},
    )


def counter_deltas(status: DataFrame, chunk_seconds: float = DAY_SECONDS) -> DataFrame:
    """Growth of every numeric counter since the sample before it.

    ``session`` restarts the history: a reconnect forgets the previous sample,
    so the first sample of a session yields no row.
    """
    numeric = status.where(F.col("value").isNotNull())
    return (
        _with_previous(numeric, chunk_seconds)
        .where(F.col("prev_t").isNotNull())
        .select(
            *SAMPLE_KEYS,
            "variable",
            "value",
            (F.col("t") - F.col("prev_t")).alias("dt"),
            delta(F.col("prev_value"), F.col("value")).alias("delta"),
        )
    )


def counter_rates(status: DataFrame, chunk_seconds: float = DAY_SECONDS) -> DataFrame:
    """Deltas over the real elapsed seconds, not the nominal interval."""
    deltas = counter_deltas(status, chunk_seconds)
    return deltas.withColumn("rate", per_second(F.col("delta"), F.col("dt")))


def wide_samples(status: DataFrame) -> DataFrame:
    """One row per sample with the counters the metrics need.

    Pivoting first keeps the look-back to one row per sample instead of one
    per counter; the pivot itself combines on the map side.
    """
    names = COUNTERS + GAUGES
    return (
        status.where(F.col("variable").isin(names))
        .groupBy(*SAMPLE_KEYS)
        .agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])
    )


def sample_pairs(status: DataFrame, chunk_seconds: float = DAY_SECONDS) -> DataFrame:
    """Each sample next to the one before it; pairs without elapsed time drop."""
    paired = look_back(
        wide_samples(status),
        keys=["server", "session"],
        order=["t", "wall_ms"],
        chunk=chunk_of(F.col("t"), chunk_seconds),
        previous={"prev_t": F.col("t"), **{f"prev_{n}": F.col(n) for n in COUNTERS}},
    )
    dt = F.col("t") - F.col("prev_t")
    return paired.withColumn("dt", dt).where(F.col("dt") > 0)


def _delta_of(name: str) -> Column:
    return delta(F.col(f"prev_{name}"), F.col(name))


def tps_with_fallback() -> Column:
    """Handler counters when the current sample reports them, zero included."""
    handlers = _delta_of("Handler_commit") + _delta_of("Handler_rollback")
    statements = _delta_of("Com_commit") + _delta_of("Com_rollback")
    amount = F.when(F.col("Handler_commit").isNotNull(), handlers).otherwise(statements)
    return per_second(amount, F.col("dt"))


def derive_metrics(
    status: DataFrame, limits: DataFrame | None = None, chunk_seconds: float = DAY_SECONDS
) -> DataFrame:
    """The fourteen metrics per sample pair.

    ``limits`` is ``(server, max_connections, ...)``, one row per server.
    """
    return metrics_of_pairs(sample_pairs(status, chunk_seconds), limits)


def metrics_of_pairs(pairs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """The fourteen metrics of rows that hold a sample, ``prev_*`` of the one before and ``dt``."""

    def rate(name: str) -> Column:
        return per_second(_delta_of(name), F.col("dt"))

    def gauge(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    written = (
        _delta_of("Innodb_rows_inserted")
        + _delta_of("Innodb_rows_updated")
        + _delta_of("Innodb_rows_deleted")
    )
    if limits is None:
        pairs = pairs.withColumn("max_connections", F.lit(None).cast("double"))
    else:
        pairs = pairs.join(limits.select("server", "max_connections"), "server", "left")
    return pairs.select(
        *SAMPLE_KEYS,
        rate("Queries").alias("qps"),
        tps_with_fallback().alias("tps"),
        rate("Slow_queries").alias("slow_qps"),
        gauge("Threads_running").alias("threads_running"),
        gauge("Threads_connected").alias("threads_connected"),
        hit_ratio(
            _delta_of("Innodb_buffer_pool_reads"), _delta_of("Innodb_buffer_pool_read_requests")
        ).alias("bp_hit_ratio"),
        rate("Bytes_received").alias("bytes_in_s"),
        rate("Bytes_sent").alias("bytes_out_s"),
        rate("Innodb_rows_read").alias("rows_read_s"),
        per_second(written, F.col("dt")).alias("rows_written_s"),
        rate("Created_tmp_disk_tables").alias("tmp_disk_tables_s"),
        rate("Table_locks_waited").alias("table_lock_waits_s"),
        rate("Aborted_connects").alias("aborted_connects_s"),
        usage_pct(gauge("Threads_connected"), F.col("max_connections")).alias("conn_usage_pct"),
    )


def metrics_long(derived: DataFrame) -> DataFrame:
    """Wide metric rows to ``(server, session, t, wall_ms, metric, value)``."""
    pct = derived.withColumn("bp_hit_pct", F.col("bp_hit_ratio") * 100.0)
    return pct.select(*SAMPLE_KEYS, *METRIC_KEYS).unpivot(
        SAMPLE_KEYS, METRIC_KEYS, "metric", "value"
    )


def metric_catalog(df_or_session) -> DataFrame:
    """The catalogue as a table of fourteen rows."""
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    return spark.createDataFrame(METRICS, "key string, label string, is_bytes boolean")


def raw_status_delta(
    status: DataFrame, needle: str = "", chunk_seconds: float = DAY_SECONDS
) -> DataFrame:
    """Every variable with its growth per second, NULL where none is known."""
    if needle:
        status = status.where(matches_needle(needle, F.col("variable")))
    paired = _with_previous(status, chunk_seconds)
    dt = F.col("t") - F.col("prev_t")
    known = (dt > 0) & (F.col("value") >= F.col("prev_value"))
    grown = F.when(known, (F.col("value") - F.col("prev_value")).cast("double") / dt)
    return paired.select(*SAMPLE_KEYS, "variable", "value_raw", grown.alias("per_s"))


def live_tail(metrics: DataFrame, points: int = LIVE_POINTS) -> DataFrame:
    """The newest points of each series.

    Spark keeps at most ``points`` rows per series on the map side before the
    exchange, so the size of a series does not matter.
    """
    newest = Window.partitionBy("server", "metric").orderBy(F.desc("t"), F.desc("wall_ms"))
    return (
        metrics.withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= points)
        .drop("_n")
    )
