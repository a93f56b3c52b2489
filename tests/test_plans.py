"""What the plans must not contain."""

from __future__ import annotations

import os

import pytest

from tidewatch.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

PYTHON_STEPS = {"dump_data", "dump_stats"}
# These run jobs while they are built.
EAGER = {q for q in catalogue.QUERIES if q.startswith("stream_")} | {"upsert_replay", "to_inserts", "dump_stats", "browse_after", "store_stats"}


def plan_of(spark, name: str) -> str:
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q not in EAGER])
def test_no_pairwise_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for step in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert name in PYTHON_STEPS or step not in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(spark, "rollup_1m")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "props" not in scan


def test_look_back_shuffles_its_rows_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("counter_rates", "evaluate_alerts", "derive_metrics"):
            assert "ReusedExchange" in plan_of(spark, name), name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_n_is_limited_before_the_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("live_tail", "read_statement_samples", "top_queries"):
            assert "WindowGroupLimit" in plan_of(spark, name), name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
