"""Snapshot tables as the operators want them.

``scan`` reads a table with its schema; every ``read_*`` then takes a DataFrame
of that shape, so the same code serves files, JDBC results and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidewatch.functions import parse_u64
from tidewatch.sources.capabilities import INDEX_USAGE, METADATA_LOCKS, gated
from tidewatch.sources.schemas import SNAPSHOT_TABLES

# Schemas that belong to the server itself.
SYSTEM_SCHEMAS = ["mysql", "information_schema", "performance_schema", "sys"]

PICOS_PER_MS = 1e9
SAMPLES_PER_DIGEST = 20  # fixed value: executions shown per digest


def scan(spark: SparkSession, table: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A snapshot table from files, with its schema enforced."""
    schema = SNAPSHOT_TABLES[table]
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def scan_jdbc(spark: SparkSession, table: str, url: str, dbtable: str, **options) -> DataFrame:
    """The same table through Spark's JDBC source, where a driver jar is on the class path."""
    df = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    return conform(df, SNAPSHOT_TABLES[table])


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of ``ddl`` by case-insensitive name; absent ones become NULL."""
    have = {c.lower(): c for c in df.columns}
    schema = StructType.fromDDL(ddl)
    return df.select(
        *[
            (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def read_status(raw: DataFrame) -> DataFrame:
    """Counters with their numeric value where the text is one, and the text."""
    return raw.withColumn("value", parse_u64(F.col("value_raw")))


def read_variables(raw: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Settings per server; with ``names`` pivoted to one row per server."""
    if names is None:
        return raw.select("server", "name", "value")
    return (
        raw.where(F.col("name").isin(names))
        .groupBy("server")
        .agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    )


def read_server_limits(variables: DataFrame) -> DataFrame:
    """Connection limit and timeouts per server, 0 where unknown."""
    names = ["max_connections", "wait_timeout", "interactive_timeout"]
    wide = read_variables(variables, names)
    zero = F.lit(0).cast("decimal(20,0)")
    return wide.select("server", *[F.coalesce(parse_u64(F.col(n)), zero).alias(n) for n in names])


def read_processlist(*tables: DataFrame, own_id: Column | int | None = None) -> DataFrame:
    """Sessions from one or both process-list tables, without the monitor's own."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if own_id is not None:
        out = out.where(F.col("id") != (F.lit(own_id) if isinstance(own_id, int) else own_id))
    empty = F.lit("")
    return out.withColumns(
        {c: F.coalesce(F.col(c), empty) for c in ("user", "host", "db", "command", "state", "info")}
    ).withColumn("time", F.coalesce(F.col("time"), F.lit(0)).cast("bigint"))


def _ms(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double") / PICOS_PER_MS, F.lit(0.0))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def read_digests(raw: DataFrame) -> DataFrame:
    """Digest counters with timers in ms.

    ``text`` is for display (a sample where the server keeps one);
    ``digest_text`` is the normalised statement that analysis reads.
    """
    return raw.select(
        "server",
        "snapshot_ts",
        F.coalesce(F.col("digest"), F.lit("")).alias("digest"),
        F.coalesce(F.col("schema_name"), F.lit("")).alias("schema"),
        "digest_text",
        F.coalesce(F.col("query_sample_text"), F.col("digest_text"), F.lit("")).alias("text"),
        _count("count_star").alias("count"),
        _ms("sum_timer_wait").alias("total_ms"),
        _ms("avg_timer_wait").alias("avg_ms"),
        _ms("max_timer_wait").alias("max_ms"),
        _ms("sum_lock_time").alias("lock_ms"),
        _count("sum_rows_examined").alias("rows_examined"),
        _count("sum_rows_sent").alias("rows_sent"),
        _count("sum_created_tmp_disk_tables").alias("tmp_disk_tables"),
        _count("sum_no_index_used").alias("no_index_used"),
        _count("sum_errors").alias("errors"),
    )


def read_statement_samples(
    raw: DataFrame, limit: int = SAMPLES_PER_DIGEST, digest: str | None = None
) -> DataFrame:
    """The newest executions of each digest on each server.

    The row-number filter also runs before the exchange, so a digest with very
    many executions ships at most ``limit`` rows per task.
    """
    if digest is not None:
        raw = raw.where(F.col("digest") == digest)
    newest = Window.partitionBy("server", "digest").orderBy(F.desc("timer_start"), "sql_text")
    return (
        raw.withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= limit)
        .select(
            "server",
            "digest",
            "timer_start",
            F.coalesce(F.col("sql_text"), F.lit("")).alias("sql"),
            _ms("timer_wait").alias("ms"),
            _ms("lock_time").alias("lock_ms"),
            _count("rows_examined").alias("rows_examined"),
            _count("rows_sent").alias("rows_sent"),
            (_count("no_index_used") != 0).alias("no_index_used"),
            (_count("no_good_index_used") != 0).alias("no_good_index_used"),
            _count("created_tmp_disk_tables").alias("tmp_disk_tables"),
            _count("errors").alias("errors"),
        )
    )


def read_transactions(raw: DataFrame) -> DataFrame:
    """Open transactions, oldest first."""
    waited = F.timestamp_diff("SECOND", F.col("wait_started"), F.col("snapshot_ts"))
    return raw.select(
        "server",
        "snapshot_ts",
        "trx_id",
        "state",
        "started",
        F.coalesce(waited, F.lit(0)).cast("bigint").alias("wait_secs"),
        _count("thread_id").alias("thread_id"),
        "rows_locked",
        "rows_modified",
        F.coalesce(F.col("isolation"), F.lit("")).alias("isolation"),
        F.coalesce(F.col("query"), F.lit("")).alias("query"),
    ).orderBy("started", "server", "trx_id")


def read_metadata_locks(raw: DataFrame, capabilities: DataFrame | None = None) -> DataFrame:
    """Metadata locks; with ``capabilities`` servers that cannot show any say so, see ``gated``."""
    kept = raw.where(F.col("schema").isNull() | (F.col("schema") != "performance_schema"))
    rows = kept.withColumns(
        {
            "schema": F.coalesce(F.col("schema"), F.lit("")),
            "name": F.coalesce(F.col("name"), F.lit("")),
            "thread_id": _count("thread_id"),
        }
    )
    return rows if capabilities is None else gated(rows, capabilities, METADATA_LOCKS)


def not_system(schema: Column) -> Column:
    return ~schema.isin(SYSTEM_SCHEMAS)


def read_index_usage(raw: DataFrame, capabilities: DataFrame | None = None) -> DataFrame:
    """Reads and writes per index since each server's start, as its newest snapshot has them.

    Rows without an index are table scans. With ``capabilities`` servers that do not count say so, see ``gated``.
    """
    rows = newest(raw).where(F.col("index").isNotNull() & not_system(F.col("schema")))
    return rows if capabilities is None else gated(rows, capabilities, INDEX_USAGE)


def read_engine_reports(df_or_session, path: str | None = None) -> DataFrame:
    """One text report per server and snapshot.

    From files, one whole report each at ``.../<server>/<epoch seconds>.txt``,
    or from a table that already holds them.
    """
    if path is None:
        return df_or_session.select("server", "snapshot_ts", "report")
    raw = df_or_session.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([0-9]+)\.txt\z"
    return raw.select(
        F.regexp_extract(name, pattern, 1).alias("server"),
        F.timestamp_seconds(F.regexp_extract(name, pattern, 2).try_cast("bigint")).alias("snapshot_ts"),
        F.col("value").alias("report"),
    )


def read_replica_status(*tables: DataFrame) -> DataFrame:
    """Channel rows of a mixed fleet; columns a table lacks become NULL."""
    texts = [t.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in t.columns]) for t in tables]
    out = texts[0]
    for t in texts[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def newest(df: DataFrame) -> DataFrame:
    """The newest snapshot of each server where snapshots are dated: cumulative counters must not be added up."""
    return latest_snapshot(df) if "snapshot_ts" in df.columns else df


def read_connected_replicas(*tables: DataFrame) -> DataFrame:
    """Replicas that are connected to each server, as it sees them, in one spelling.

    Both generations of the list name the same five things; a port or id that is no number is NULL.
    """
    rows = read_replica_status(*tables)

    def first(*names: str) -> Column:
        have = [F.col(f"`{n}`") for n in names if n in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    return rows.select(
        "server",
        first("Server_Id", "Server_id").try_cast("bigint").alias("replica_id"),
        F.coalesce(first("Host"), F.lit("")).alias("host"),
        first("Port").try_cast("int").alias("port"),
        first("Source_Id", "Master_Id", "Master_id").try_cast("bigint").alias("source_id"),
        F.coalesce(first("Replica_UUID", "Slave_UUID"), F.lit("")).alias("uuid"),
    )


def latest_snapshot(df: DataFrame, by: str = "snapshot_ts", keys: list[str] | None = None) -> DataFrame:
    """Rows of the newest snapshot of each server.

    A maximum per server is a map-side aggregate; ranking all rows would send
    everything one server has to a single task.
    """
    keys = keys or ["server"]
    newest = df.groupBy(*keys).agg(F.max(by).alias(by))
    return df.join(newest, [*keys, by], "left_semi")
