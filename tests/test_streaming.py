"""Streams over several micro-batches, late data included."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators.alerts import Rule, alert_transitions, evaluate_alerts
from tidewatch.operators.rates import COUNTERS, GAUGES, METRIC_KEYS, derive_metrics, metrics_long
from tidewatch.operators.series import rollup_1m
from tidewatch.streaming import jobs, store

STATUS = "server string, session string, variable string, t double, wall_ms bigint, value decimal(20,0)"
START = 10**12
SAMPLES = "server string, metric string, ts bigint, value double"


def feed(spark, tmp_path, schema, batches):
    for i, rows in enumerate(batches):
        part = str(tmp_path / "in" / f"{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return files.parquet(str(tmp_path / "in" / "*"))


def drain(stream, tmp_path, folder="out"):
    run = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / folder))
        .option("checkpointLocation", str(tmp_path / f"ckpt-{folder}")).outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / folder))


def test_rates_remember_the_last_sample(spark, tmp_path):
    def row(t, v):
        return ("s", "1", "Queries", t, int(t * 1000), Decimal(v))

    batches = [[row(1.0, 10.0), row(3.0, 30.0)], [row(5.0, 70.0)], [row(4.0, 60.0)], [row(6.0, 5.0), row(8.0, 25.0)]]
    out = drain(jobs.stream_rates(feed(spark, tmp_path, STATUS, batches)), tmp_path)
    got = [(r.t, r.rate) for r in out.orderBy("t").collect()]
    # 4.0 comes late: rate 0, and it is what 6.0 is compared with; 6.0 is a reset.
    assert got == [(3.0, 10.0), (4.0, 0.0), (5.0, 20.0), (6.0, 0.0), (8.0, 10.0)]


def test_late_samples_are_repaired_in_batch(spark, tmp_path):
    minute = 60_000
    batches = [
        [("s", "m", 5, 1.0), ("s", "m", 10, 3.0)],
        [("s", "m", 10 * minute, 9.0)],
        [("s", "m", 11 * minute, 9.0)],  # the batch that closes minute 0
        [("s", "m", 20, 5.0)],  # too late
        [("s", "m", 30 * minute, 9.0)],
    ]
    out = drain(jobs.stream_rollup_1m(feed(spark, tmp_path, SAMPLES, batches)), tmp_path)
    streamed = {r.ts: (r.avg, r.min, r.max) for r in out.collect()}
    assert streamed[0] == (2.0, 1.0, 3.0) and streamed[10 * minute] == (9.0, 9.0, 9.0)
    everything = spark.createDataFrame([r for b in batches for r in b], SAMPLES)
    repaired = jobs.refold(out, everything.where(F.col("ts") < minute))
    assert {r.ts: r.avg for r in repaired.collect()} == {0: 3.0, 10 * minute: 9.0, 11 * minute: 9.0}
    assert rollup_1m(everything).count() == 4


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = SAMPLES + ", seq bigint"
    first = spark.createDataFrame([("a", "m", 1, 1.0, 1), ("a", "m", 2, 2.0, 2), ("b", "m", 1, 7.0, 3)], schema)
    second = spark.createDataFrame([("a", "m", 1, 5.0, 4), ("a", "m", 90_000_000, 6.0, 5), (None, "m", 1, 1.0, 6)], schema)
    for batch in (first, second, second, first):
        store.merge_samples(batch, path)
    rows = store.read_store(spark, path)
    got = {(r.server, r.ts): r.value for r in rows.collect()}
    assert rows.count() == 4
    assert got == {("a", 1): 5.0, ("a", 2): 2.0, ("b", 1): 7.0, ("a", 90_000_000): 6.0}


def test_silent_counters_are_forgotten(spark, tmp_path):
    day = 86_400.0

    def row(session, t, v):
        return ("s", session, "Queries", t, int(t * 1000), Decimal(v))

    batches = [[row("old", 1.0, 10.0)], [row("new", 3 * day, 1.0)], [row("new", 3 * day + 1, 2.0)], [row("old", 3 * day + 2, 30.0)]]
    out = drain(jobs.stream_rates(feed(spark, tmp_path, STATUS, batches)), tmp_path)
    assert [(r.session, r.rate) for r in out.collect()] == [("new", 1.0)]


def test_upsert_reads_the_days_of_the_batch_only(spark, tmp_path):
    path, schema = str(tmp_path / "store"), SAMPLES + ", seq bigint"
    days = [("a", "m", day * 86_400_000, float(day), day) for day in range(4)]
    store.merge_samples(spark.createDataFrame([], schema), path)
    assert store.read_store(spark, path).count() == 0
    store.merge_samples(spark.createDataFrame([*days, ("a", "m", None, 1.0, 9)], schema), path)
    read = store.read_store(spark, path, 1, 2)
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "day" in filters and ">= 1" in filters and "<= 2" in filters
    assert sorted(r.value for r in read.collect()) == [1.0, 2.0]


@pytest.mark.parametrize("step", ["data", "manifest", "switch"])
def test_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch, step):
    """A merge that fails while it writes data, or before the switch, leaves the old rows; the next one goes on."""
    path, schema = str(tmp_path / "store"), SAMPLES + ", seq bigint"
    old = [("a", "m", 1, 1.0, 1), ("b", "m", 2, 2.0, 2)]
    store.merge_samples(spark.createDataFrame(old, schema), path)
    before = store.read_store(spark, path)
    batch = spark.createDataFrame([("a", "m", 1, 9.0, 7), ("c", "m", 5, 5.0, 8)], schema)
    with monkeypatch.context() as patch:
        if step == "data":
            # Half of the rows are written when a task fails.
            broken = F.when(F.col("server") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("value"))
            failing = batch.withColumn("value", broken.cast("double"))
        else:
            failing = batch
            name = "_switch" if step == "switch" else "MANIFEST_SCHEMA"
            patch.setattr(store, name, (lambda *_: 1 / 0) if step == "switch" else "no schema at all")
        with pytest.raises(Exception):
            store.merge_samples(failing, path)
    values = lambda: sorted((r.server, r.value) for r in store.read_store(spark, path).collect())
    assert values() == [("a", 1.0), ("b", 2.0)]
    store.merge_samples(batch, path)
    assert values() == [("a", 9.0), ("b", 2.0), ("c", 5.0)]
    # A reader that began before the merge still reads what it began with; then old folders go.
    assert sorted(r.value for r in before.collect()) == [1.0, 2.0]
    store.merge_samples(spark.createDataFrame([("b", "m", 2, 3.0, 9)], schema), path)
    assert store.vacuum(spark, path) > 0 and values() == [("a", 9.0), ("b", 3.0), ("c", 5.0)]


def status_rows(seed, seconds=120):
    """Samples of two servers every second, with resets, missing counters and a second session."""
    draw = random.Random(seed)
    rows = []
    for server in ("a", "b"):
        value = {n: 2**60 + draw.randrange(1000) for n in COUNTERS}
        for s in range(seconds):
            session = "1" if s < seconds // 2 else "2"
            for n in COUNTERS:
                value[n] = 3 if draw.random() < 0.01 else value[n] + draw.randrange(5)
                if n != "Handler_commit" or draw.random() < 0.8:
                    rows.append((server, session, n, float(s), START + s * 1000, Decimal(value[n])))
            rows += [(server, session, n, float(s), START + s * 1000, Decimal(draw.randrange(60))) for n in GAUGES]
    return rows


def test_metrics_of_out_of_order_batches_lead_to_alerts(spark, tmp_path):
    """Status rows through the metric stream to alert transitions, against the batch jobs."""
    draw = random.Random(2)
    rows = status_rows(1)
    # Every row comes up to 20 seconds late, in another order; the last batch closes the feed.
    order = sorted(rows, key=lambda r: r[3] + 20 * draw.random())
    cut = [order[k : k + 900] for k in range(0, len(order), 900)]
    feed_rows = [*cut, [("", "", "Queries", 1e6, START + 10**9, Decimal(1))]]
    status = feed(spark, tmp_path, STATUS, feed_rows)
    limits = spark.createDataFrame([("a", Decimal(80))], "server string, max_connections decimal(20,0)")
    samples = drain(jobs.stream_samples(status, "60 seconds"), tmp_path, "samples")
    whole = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "samples"))
    metrics = drain(jobs.stream_derive_metrics(whole, limits, chunk_seconds=25), tmp_path)
    want = derive_metrics(spark.createDataFrame(rows, STATUS), limits)
    assert sorted(map(tuple, metrics.collect())) == sorted(map(tuple, want.collect()))
    assert {"qps", "tps"} <= set(metrics.columns) and metrics.count() == 2 * 118

    long = metrics_long(metrics).select("server", "session", "t", "wall_ms", "metric", "value")
    batches = [[tuple(r) for r in long.where((F.col("t") >= lo) & (F.col("t") < lo + 30)).collect()] for lo in range(0, 120, 30)]
    home = tmp_path / "second"
    rules = [Rule(k, m, "above", limit, hold) for k, (m, limit, hold) in enumerate([("threads_running", 20.0, 2.0), ("qps", 1.0, 0.0), ("conn_usage_pct", 30.0, 4.0)])]
    got = drain(jobs.stream_alerts(feed(spark, home, long.schema, batches), rules, chunk_seconds=7), home)
    want = alert_transitions(evaluate_alerts(long, rules))
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert want.count() > 20 and set(METRIC_KEYS) == {r.metric for r in long.select("metric").distinct().collect()}


@pytest.mark.parametrize("seed", range(6))
def test_alert_chunks_equal_the_state_machine(seed):
    """Chunks and borders put together, row by row as the definition says."""
    draw = random.Random(seed)
    t, rows = 0.0, []
    for _ in range(300):
        t += draw.choice([0.5, 1.0, 3.0])
        rows.append((t, draw.random() < draw.choice([0.3, 0.9])))
    hold = draw.choice([0.0, 2.0, 9.0, 40.0])
    since, firing, want = None, False, []
    for at, breach in rows:
        if breach:
            since = at if since is None else since
            if not firing and at - since >= hold:
                firing = True
                want.append((at, "fired"))
        else:
            if firing:
                want.append((at, "resolved"))
            since, firing = None, False

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, value):
            pass

    state, got, k = State(), [], 0
    while k < len(rows):
        part = rows[k : k + draw.randint(1, 20)]
        k += len(part)
        table = pa.table(
            {
                "server": ["s"] * len(part), "session": ["1"] * len(part), "rule_id": pa.array([1] * len(part), pa.int32()),
                "t": [p[0] for p in part], "wall_ms": [int(p[0] * 1000) for p in part], "value": [1.0] * len(part),
                "_chunk": [0] * len(part), "for_secs": [hold] * len(part), "breach": [p[1] for p in part], "rule": ["r"] * len(part),
            }
        )
        table = table.take(pa.array(np.random.default_rng(k).permutation(len(part))))
        inside = jobs._alerts_inside(table)
        got += list(zip(inside.column("t").to_pylist(), inside.column("transition").to_pylist()))
        for out in jobs._alerts_over_borders(("s", "1", 1), iter([jobs._alerts_border(table).to_pandas()]), state):
            got += list(zip(out["t"], out["transition"]))
    assert sorted(got) == want


def test_a_backlog_of_one_counter_goes_by_chunks(spark, tmp_path, monkeypatch):
    """A million rows of one counter in one batch: no frame holds a twentieth, and growth of one shows above 2**53."""
    n = 1_000_000
    start = 2**53 + 1
    rows = spark.range(n).select(
        F.lit("s").alias("server"), F.lit("1").alias("session"), F.lit("Queries").alias("variable"),
        F.col("id").cast("double").alias("t"), (F.col("id") * 1000 + START).alias("wall_ms"),
        (F.col("id") + F.lit(start)).cast("decimal(20,0)").alias("value"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)
    borders = spark.sparkContext.accumulator(0)
    from tidewatch.streaming import chunks

    sort, join = chunks.in_order, chunks.frames_in_order

    def counted(table, keys, order):
        if table.num_rows > n // 20:
            seen.add(1)
        return sort(table, keys, order)

    def joined(parts, order):
        found = join(parts, order)
        borders.add(len(found))
        return found

    monkeypatch.setattr(chunks, "in_order", counted)
    monkeypatch.setattr(chunks, "frames_in_order", joined)
    out = drain(jobs.stream_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert out.agg(F.count("*"), F.min("rate"), F.max("rate")).first() == (n - 1, 1.0, 1.0)
    assert seen.value == 0 and borders.value in (0, -(-n // 3600))
