"""Facts about rates that must hold sample by sample."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import parse_u64
from tidewatch.operators.rates import derive_metrics, metrics_long, raw_status_delta
from tidewatch.sources.snapshots import read_status

SCHEMA = "server string, session string, t double, wall_ms bigint, variable string, value_raw string"


def pair(spark, before: dict, after: dict, dt: float = 2.0):
    rows = [("s", "1", 10.0, 10_000, k, str(v)) for k, v in before.items()]
    rows += [("s", "1", 10.0 + dt, int((10 + dt) * 1000), k, str(v)) for k, v in after.items()]
    return read_status(spark.createDataFrame(rows, SCHEMA))


def one(spark, before, after, dt=2.0):
    return derive_metrics(pair(spark, before, after, dt)).collect()


def test_rates_use_the_real_interval(spark):
    (m,) = one(spark, {"Queries": 100, "Bytes_sent": 0}, {"Queries": 150, "Bytes_sent": 4096}, 2.5)
    assert m.qps == 20.0 and m.bytes_out_s == 4096 / 2.5


def test_a_reset_counts_as_no_growth(spark):
    (m,) = one(spark, {"Queries": 9_000_000}, {"Queries": 12})
    assert m.qps == 0.0


def test_no_elapsed_time_gives_no_row(spark):
    assert one(spark, {"Queries": 1}, {"Queries": 2}, 0.0) == []


def test_handler_counters_win_even_at_zero(spark):
    (m,) = one(spark, {"Handler_commit": 0, "Com_commit": 0}, {"Handler_commit": 0, "Com_commit": 50})
    assert m.tps == 0.0
    (m,) = one(spark, {"Com_commit": 0, "Com_rollback": 0}, {"Com_commit": 50, "Com_rollback": 10})
    assert m.tps == 30.0


def test_hit_ratio(spark):
    keys = ("Innodb_buffer_pool_reads", "Innodb_buffer_pool_read_requests")
    (m,) = one(spark, dict.fromkeys(keys, 0), {keys[0]: 10, keys[1]: 1000})
    assert m.bp_hit_ratio == pytest.approx(0.99)
    (m,) = one(spark, dict.fromkeys(keys, 5), dict.fromkeys(keys, 5))
    assert m.bp_hit_ratio == 1.0


def test_rows_written_sums_three_counters(spark):
    keys = ["Innodb_rows_inserted", "Innodb_rows_updated", "Innodb_rows_deleted"]
    (m,) = one(spark, dict.fromkeys(keys, 0), {keys[0]: 10, keys[1]: 20, keys[2]: 30})
    assert m.rows_written_s == 30.0


def test_fourteen_metrics_in_long_form(spark):
    long = metrics_long(derive_metrics(pair(spark, {"Queries": 0}, {"Queries": 4})))
    assert long.count() == 14
    assert long.where("metric = 'bp_hit_pct'").first().value == 100.0


def test_a_counter_seen_for_the_first_time_has_no_growth(spark):
    (m,) = one(spark, {"Threads_running": 1}, {"Queries": 5000, "Threads_running": 2})
    assert m.qps == 0.0 and m.threads_running == 2.0


def test_raw_delta_is_null_where_unknown(spark):
    rows = {(r.t, r.variable): r.per_s for r in raw_status_delta(pair(spark, {"A": 5, "B": "ON"}, {"A": 9, "B": "OFF"})).collect()}
    assert rows == {(10.0, "A"): None, (10.0, "B"): None, (12.0, "A"): 2.0, (12.0, "B"): None}


@pytest.mark.parametrize(
    ("text", "value"),
    [("7", 7), ("+7", 7), (" 7", None), ("1.5", None), ("-1", None), ("", None), ("7\n", None),
     ("18446744073709551615", 18446744073709551615), ("18446744073709551616", None)],
)
def test_unsigned_parse(spark, text, value):
    got = spark.createDataFrame([(text,)], "x string").select(parse_u64(F.col("x")).alias("v")).first().v
    assert (None if got is None else int(got)) == value
