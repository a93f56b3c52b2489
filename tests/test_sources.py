"""Readers: schemas, mixed spellings, versions, files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.export import to_markdown
from tidewatch.operators.replication import coalesce_aliases, normalize_replicas, with_health
from tidewatch.plans import catalogue
from tidewatch.sources import snapshots as S
from tidewatch.sources.capabilities import capability_summary, server_capabilities
from tidewatch.sources.schemas import DIGESTS_RAW, SNAPSHOT_TABLES


def test_scan_enforces_the_schema(spark, tmp_path):
    spark.sql("SELECT 's' AS server, 'a' AS NAME, 'b' AS value, 1 AS extra").write.json(str(tmp_path / "v"))
    df = S.scan(spark, "variables", str(tmp_path / "v"), "json")
    assert df.columns == ["server", "name", "value"]
    assert set(SNAPSHOT_TABLES) >= {"status", "digests", "trx", "engine_reports"}


def test_conform_fills_absent_columns(spark):
    df = S.conform(spark.sql("SELECT 's' AS SERVER, 5 AS Count_Star"), DIGESTS_RAW)
    row = S.read_digests(df).first()
    assert (row.server, row["count"], row.total_ms, row.text) == ("s", 5, 0.0, "")


def test_reports_from_files(spark, tmp_path):
    (tmp_path / "db1").mkdir()
    (tmp_path / "db1" / "1700000000.txt").write_text("Log sequence number 5\nmore\n")
    (row,) = S.read_engine_reports(spark, str(tmp_path)).select("server", F.unix_seconds("snapshot_ts").alias("t"), "report").collect()
    assert (row.server, row.t, row.report) == ("db1", 1700000000, "Log sequence number 5\nmore\n")


def test_limits_default_to_zero(spark):
    rows = [("a", "max_connections", "151"), ("b", "wait_timeout", "x")]
    got = {r.server: int(r.max_connections) for r in S.read_server_limits(spark.createDataFrame(rows, "server string, name string, value string")).collect()}
    assert got == {"a": 151, "b": 0}


@pytest.mark.parametrize(
    ("version", "comment", "flavor", "on", "off"),
    [
        ("5.6.49", "", "MySQL", ["innodb_trx"], ["sys_schema", "ps_data_locks"]),
        ("5.7.31-debug", "", "MySQL", ["sys_schema", "metadata_locks"], ["ps_data_locks"]),
        ("8.0.12", "", "MySQL", ["ps_data_locks"], ["ps_processlist", "invisible_index"]),
        ("8.4.3", "", "MySQL", ["ps_processlist", "replica_terms", "invisible_index"], ["perf_schema_on"]),
        ("8.0.1", "", "MySQL", ["digest_sample_text"], ["invisible_index"]),
        ("10.9.8-MariaDB-harbour", "", "MariaDB", ["sys_schema", "metadata_locks"], ["ps_data_locks", "replica_terms"]),
        ("9.0.1-1", "percona, packed by us", "Percona", ["replica_terms"], []),
        ("not told", "", "Unknown", [], ["innodb_trx", "sys_schema"]),
    ],
)
def test_versions(spark, version, comment, flavor, on, off):
    df = spark.createDataFrame([("s", version, comment)], "server string, version string, version_comment string")
    row = server_capabilities(df).first()
    assert row.flavor == flavor
    assert all(row[f] for f in on) and not any(row[f] for f in off)


def test_summary_names_the_lock_source(spark):
    df = spark.createDataFrame([("s", "8.4.3", ""), ("t", "5.7.2", "")], "server string, version string, version_comment string")
    caps = server_capabilities(df, perf_schema_on=F.lit(True))
    got = {r.server: r.x for r in caps.select("server", capability_summary().alias("x")).collect()}
    assert got == {
        "s": "perf_schema · ps.processlist · data_locks · digest · sys",
        "t": "perf_schema · innodb_locks · digest · sys",
    }


def test_null_alias_does_not_mask_the_other(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS Source_Host, 'old' AS MASTER_HOST, '' AS Source_User, 'x' AS Master_User")
    got = df.select(
        coalesce_aliases(df, ["Source_Host", "Master_Host"]).alias("h"),
        coalesce_aliases(df, ["Source_User", "Master_User"]).alias("u"),
        coalesce_aliases(df, ["Nope"]).alias("n"),
    ).first()
    assert (got.h, got.u, got.n) == ("old", "", None)


@pytest.mark.parametrize(
    ("lag", "health"),
    [("29", "good"), ("30", "watch"), ("299", "watch"), (" 300 ", "bad"), (None, "bad"), ("x", "bad")],
)
def test_lag_bands(spark, lag, health):
    df = spark.createDataFrame(
        [("s", "Yes", "YES", lag, "f", "9000", "f", "3000", "0", "")],
        "server string, Slave_IO_Running string, Replica_SQL_Running string, Seconds_Behind_Master string, "
        "Master_Log_File string, Read_Master_Log_Pos string, Relay_Master_Log_File string, "
        "Exec_Master_Log_Pos string, Last_IO_Errno string, Last_IO_Error string",
    )
    row = with_health(normalize_replicas(df)).first()
    assert row.health == health and int(row.apply_backlog_bytes) == 6000
    assert row.error_text is None


def test_markdown_keeps_a_group_without_a_name(spark):
    df = spark.createDataFrame([(None, 1), ("g", 2)], "g string, id int")
    assert to_markdown(df, ["g"], ["id"]).where("part = 2").count() == 2


def test_every_session_keeps_its_statement(spark, tmp_path):
    at = dt.datetime(2026, 1, 2)
    orders = [(k, 1, s, 1.0, at, p) for k, s, p in [(4, "F", "a"), (7, "F", "b"), (7, "F", "b"), (-3, "P", "c"), (9, "O", "d"), (5, "F", "e"), (None, "F", "f")]]
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    rows = catalogue.QUERIES["read_processlist"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.info) for r in rows) == [(-3, "SELECT c"), (4, "SELECT a"), (7, "SELECT b"), (7, "SELECT b"), (9, "")]


def test_a_process_list_without_statements(spark):
    with_info = spark.sql("SELECT 's' AS server, 1L AS id, 'u' AS user, 'h' AS host, 'd' AS db, 'Query' AS command, 2L AS time, '' AS state, 'SELECT 1' AS info")
    rows = S.read_processlist(with_info, with_info.withColumn("id", F.lit(2)).drop("info"), own_id=5).collect()
    assert {r.id: r.info for r in rows} == {1: "SELECT 1", 2: ""}
