"""Pages by key, capability gates, newest snapshots and stored sizes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import catalog as K
from tidewatch.operators.indexes import full_table_scans
from tidewatch.operators.series import store_stats
from tidewatch.sources import snapshots as S
from tidewatch.sources.capabilities import server_capabilities


def table(spark, n=97):
    draw = random.Random(3)
    rows = [(k, draw.choice([None, "a", "b", "c'c"]), draw.choice([None, 0.5, -1.0, 2.25])) for k in range(n)]
    return spark.createDataFrame(rows, "id bigint, name string, size double")


@pytest.mark.parametrize("order_by", [None, "name", "size", "id"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_key_walk_the_whole_table(spark, order_by, descending):
    """Every row once, in the order of the plain sort, NULLs included."""
    df = table(spark).cache()
    how = {"order_by": order_by, "descending": descending, "condition": "id % 5 <> 3"}
    first = [F.col(order_by).desc() if descending else F.col(order_by).asc()] if order_by else []
    want = [r.id for r in df.where("id % 5 <> 3").orderBy(*first, "id").collect()]
    got, end, more = [], None, True
    while more:
        page = K.browse_after(df, end, ["id"], limit=20, **how)
        rows = page.orderBy(*first, "id").collect()
        got += [r.id for r in rows]
        more = rows[0].has_more
        end = K.page_end(page, ["id"], order_by, descending)
    assert got == want
    assert K.browse_after(df, end, ["id"], limit=20, **how).count() == 0
    assert K.page_end(df.where("false"), ["id"]) is None


def test_a_deep_page_hands_over_one_page(spark, tmp_path):
    """The position reaches the scan, and each task keeps one page."""
    spark.range(200_000).withColumn("v", F.col("id") % 100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    page = K.browse_after(df, {"id": 199_899}, ["id"], limit=20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,199899)" in plan and "TakeOrderedAndProject(limit=21" in plan
    assert sorted(r.id for r in page.collect()) == list(range(199_900, 199_920))


FLEET = [("new", "8.4.2", ""), ("quiet", "8.4.2", ""), ("old", "5.5.9", ""), ("off", "9.0.1", ""), ("odd", "no number", "")]


def fleet(spark):
    servers = spark.createDataFrame(FLEET, "server string, version string, version_comment string")
    return server_capabilities(servers, perf_schema_on=F.col("server") != "off")


def test_a_server_without_the_feature_says_so(spark):
    """Rows of able servers, none of a quiet one, and one row for each that cannot tell."""
    now = dt.datetime(2027, 5, 4)
    schema = "server string, snapshot_ts timestamp, object_type string, schema string, name string, lock_type string, lock_status string, thread_id bigint"
    rows = [(s, now, "TABLE", "d", "t", "X", "GRANTED", 4) for s in ("new", "old", "off", "stranger")]
    locks = S.read_metadata_locks(spark.createDataFrame(rows, schema), fleet(spark)).collect()
    assert sorted((r.server, r.supported, r.name) for r in locks) == [("new", True, "t"), ("odd", False, None), ("off", False, None), ("old", False, None)]


def usage(spark):
    early, late = dt.datetime(2027, 5, 1), dt.datetime(2027, 5, 2)
    rows = [
        ("new", early, "d", "t", "ix", 5, 1), ("new", late, "d", "t", "ix", 9, 2), ("new", late, "d", "t", None, 3, 0),
        ("new", early, "d", "gone", "ix", 5, 1), ("off", late, "d", "t", "ix", 1, 1), ("quiet", late, "mysql", "t", "ix", 1, 1),
    ]
    return spark.createDataFrame(rows, "server string, snapshot_ts timestamp, schema string, table string, index string, reads bigint, writes bigint")


def test_cumulative_counters_are_those_of_the_newest_snapshot(spark):
    got = S.read_index_usage(usage(spark), fleet(spark)).collect()
    assert sorted((r.server, r.table, r.reads, r.supported) for r in got if r.supported) == [("new", "t", 9, True)]
    assert {r.server for r in got if not r.supported} == {"old", "off", "odd"}
    tables = spark.createDataFrame([("new", "d", "t", 70)], "server string, schema string, table string, table_rows bigint")
    scans = full_table_scans(usage(spark), tables, capabilities=fleet(spark)).where("supported").collect()
    assert [(r.server, r.rows_full_scanned, r.table_rows) for r in scans] == [("new", 3, 70)]


def test_suggestions_and_findings_read_the_newest_digests(spark):
    from tidewatch.operators.advisor import function_on_column, statement_findings
    from tidewatch.operators.suggest import merge_proposals, proposals

    base = {"server": "s", "digest": "d", "schema": "x", "digest_text": "SELECT a FROM t WHERE b = ? AND ABS(c) = ?", "text": "q", "total_ms": 2.0}
    zero = dict.fromkeys(["rows_examined", "rows_sent", "tmp_disk_tables"], 0)
    rows = [{**base, **zero, "snapshot_ts": dt.datetime(2027, 1, d), "count": 20 * d, "no_index_used": 1} for d in (1, 2, 3)]
    df = spark.createDataFrame(rows)
    assert [r.executions for r in merge_proposals(proposals(df)).collect()] == [60]
    assert statement_findings(df).count() == 1 and function_on_column(df).count() == 1


def test_connected_replicas_of_both_generations(spark):
    new = spark.createDataFrame([("a", "7", "h1", "3306", "1", "u-1")], "server string, Server_Id string, Host string, Port string, Source_Id string, Replica_UUID string")
    old = spark.createDataFrame([("b", "8", None, "x", "2")], "server string, Server_id string, Host string, Port string, Master_id string")
    got = {r.server: tuple(r)[1:] for r in S.read_connected_replicas(new, old).collect()}
    assert got == {"a": (7, "h1", 3306, 1, "u-1"), "b": (8, "", None, 2, "")}


def test_stored_size_is_that_of_the_files(spark, tmp_path):
    raw = spark.range(500).selectExpr("'s' AS server", "'m' AS metric", "id AS ts", "double(id) AS value")
    folded = raw.where("id < 0").selectExpr("server", "metric", "ts", "value AS avg")
    raw.repartition(3).write.parquet(str(tmp_path / "raw"))
    folded.write.parquet(str(tmp_path / "rollup"))
    paths = [str(tmp_path / "raw"), str(tmp_path / "rollup")]
    got = store_stats(spark.read.schema(raw.schema).parquet(paths[0]), spark.read.schema(folded.schema).parquet(paths[1]), paths).first()
    files = [f for p in paths for f in (tmp_path / p).glob("*.parquet")]
    assert (got.raw_rows, got.rollup_rows, got.oldest_ms, got.stored_bytes) == (500, 0, 0, sum(f.stat().st_size for f in files))
    assert store_stats(raw, folded).first().stored_bytes is None
