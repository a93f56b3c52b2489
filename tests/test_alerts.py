"""Batch alerts, streamed alerts and a plain state machine agree."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.alerts import (
    DEFAULT_RULES,
    Rule,
    alert_states,
    alert_transitions,
    describe_rule,
    evaluate_alerts,
    rules_table,
)
from tidewatch.streaming.jobs import stream_alerts

SCHEMA = "server string, session string, t double, wall_ms bigint, metric string, value double"


def machine(rows, rule: Rule):
    """The rule as a state machine, one sample at a time."""
    state, since, events = "ok", None, []
    for _srv, _ses, t, _ms, _m, v in sorted(rows, key=lambda r: r[2]):
        hit = rule.enabled and v == v and (v > rule.threshold if rule.cmp == "above" else v < rule.threshold)
        if not hit:
            if state == "firing":
                events.append((t, "resolved"))
            state, since = "ok", None
        elif state == "ok":
            state, since = ("firing", t) if rule.for_secs <= 0 else ("pending", t)
            if state == "firing":
                events.append((t, "fired"))
        elif state == "pending" and t - since >= rule.for_secs:
            state, since = "firing", t
            events.append((t, "fired"))
    return events, state, since


def samples(seed: int):
    rng = random.Random(seed)
    out = []
    for server in ("a", "b"):
        for session in ("1", "2"):
            t = rng.random() * 100
            for _ in range(120):
                t += rng.choice([0.5, 1.0, 4.0, 9.0])
                value = rng.choice([1.0, 1.0, 9.0, 9.0, 9.0, 5.0, float("nan")])
                out.append((server, session, t, int(t * 1000), "qps", value))
    return out


RULES = [
    Rule(1, "qps", "above", 5.0, 0.0),
    Rule(2, "qps", "above", 5.0, 8.0),
    Rule(3, "qps", "below", 6.0, 5.0),
    Rule(4, "qps", "above", 0.0, 30.0),
    Rule(5, "qps", "above", 0.0, 0.0, enabled=False),
]


@pytest.mark.parametrize("chunk", [3.0, 50.0, 86_400.0])
def test_batch_equals_the_state_machine(spark, chunk):
    rows = samples(int(chunk))
    evaluated = evaluate_alerts(spark.createDataFrame(rows, SCHEMA), RULES, chunk).cache()
    events = {(r.server, r.session, r.rule_id, r.t, r.transition) for r in alert_transitions(evaluated).collect()}
    states = {(r.server, r.session, r.rule_id): (r.status, r.since) for r in alert_states(evaluated).collect()}
    want = set()
    for server in ("a", "b"):
        for session in ("1", "2"):
            own = [r for r in rows if r[:2] == (server, session)]
            for rule in RULES:
                found, state, since = machine(own, rule)
                want |= {(server, session, rule.rule_id, t, e) for t, e in found}
                assert states[(server, session, rule.rule_id)] == (state, since)
    assert events == want
    evaluated.unpersist()


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(samples(11), key=lambda r: r[2])
    for i in range(4):  # four micro-batches, in time order
        part = rows[i * 120 : (i + 1) * 120]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (
        stream_alerts(stream, RULES).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("server", "session", "rule_id", "t", "transition").collect()}
    batch = alert_transitions(evaluate_alerts(spark.createDataFrame(rows, SCHEMA), RULES))
    assert got == {tuple(r) for r in batch.select("server", "session", "rule_id", "t", "transition").collect()}


def test_default_rules_describe_themselves(spark):
    text = describe_rule(F.col("metric"), F.col("cmp"), F.col("threshold"), F.col("for_secs"))
    shown = {r.rule_id: r.d for r in rules_table(spark, [*DEFAULT_RULES, Rule(9, "tps", "above", 2.5, 1.0)]).select("rule_id", text.alias("d")).collect()}
    assert shown[1] == "Connection usage % > 80 for 30s"
    assert shown[4] == "Buffer pool hit % < 95 for 60s"
    assert shown[9] == "Transactions/s > 2.50 for 1s"
