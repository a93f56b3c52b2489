"""Structured Streaming forms of the rate, rollup, alert and upsert jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.alerts import STATE_KEYS, Rule, breached, describe_rule, rules_table
from tidewatch.operators.rates import COUNTERS, GAUGES, SAMPLE_KEYS, delta, metrics_of_pairs, per_second
from tidewatch.operators.series import SERIES_KEYS, rollup_1m
from tidewatch.operators.timeline import chunk_of
from tidewatch.streaming.chunks import EVENT_TIME, HOUR_SECONDS, bucketed, frames_in_order, in_order, keep_until, stream_look_back
from tidewatch.streaming.store import merge_samples

# ---------------------------------------------------------------- rollup


def stream_rollup_1m(samples: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Tumbling minutes of ``(server, metric, ts, value)``, ``ts`` in millis.

    A minute is final once the watermark passes its end; samples that arrive
    later are dropped here and repaired by ``refold`` in batch.
    """
    timed = samples.withColumn("event_time", F.timestamp_millis("ts"))
    minute = F.window("event_time", "1 minute")
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(minute, *SERIES_KEYS)
        .agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
        .select(
            *SERIES_KEYS, F.unix_millis("window.start").alias("ts"), "avg", "min", "max"
        )
    )


def refold(rollups: DataFrame, samples: DataFrame) -> DataFrame:
    """Rollups with the minutes found in ``samples`` folded anew."""
    fresh = rollup_1m(samples)
    return rollups.join(fresh, [*SERIES_KEYS, "ts"], "left_anti").unionByName(fresh)


# ----------------------------------------------------------------- rates

RATE_KEYS = ["server", "session", "variable"]
SAMPLE_ORDER = ["t", "wall_ms"]

#: How long the state of a silent key stays, and how late a row may come.
IDLE = "1 day"


def stream_rates(status: DataFrame, idle: str = IDLE, chunk_seconds: float = HOUR_SECONDS) -> DataFrame:
    """Counter growth per second since the sample before, across micro-batches.

    Counters are subtracted as decimals, so growth of one shows at any height. A sample that is
    not newer than the last one gives a rate of zero and still becomes the last one. A
    counter that is silent for ``idle`` (its session ended, say) is forgotten.
    """
    numeric = status.where(F.col("value").isNotNull()).select(
        *RATE_KEYS, "t", "wall_ms", F.col("value").cast("decimal(20,0)").alias("value")
    )
    paired = stream_look_back(numeric, RATE_KEYS, SAMPLE_ORDER, chunk_of(F.col("t"), chunk_seconds), ["t", "value"], idle)
    grown = delta(F.col("prev_value"), F.col("value"))
    return paired.select(*RATE_KEYS, "t", "wall_ms", per_second(grown, F.col("t") - F.col("prev_t")).alias("rate"))


# --------------------------------------------------------------- metrics


def stream_samples(status: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Whole samples, a column for each counter the metrics need, as they become complete.

    Counters of one sample may come in any order and in several batches. A sample is complete when
    the watermark, ``delay`` behind the newest wall clock, has passed it; the newest samples stay open
    until later ones come. The state is one row for each open sample.
    """
    timed = status.withColumn(EVENT_TIME, F.timestamp_millis("wall_ms")).withWatermark(EVENT_TIME, delay)
    names = COUNTERS + GAUGES
    return (
        timed.where(F.col("variable").isin(names))
        .groupBy(EVENT_TIME, *SAMPLE_KEYS)
        .agg(*[F.max(F.when(F.col("variable") == n, F.col("value").cast("decimal(20,0)"))).alias(n) for n in names])
        .drop(EVENT_TIME)
    )


def stream_derive_metrics(
    samples: DataFrame, limits: DataFrame | None = None, idle: str = IDLE, chunk_seconds: float = HOUR_SECONDS
) -> DataFrame:
    """The fourteen metrics of each sample against the one before it, across micro-batches.

    ``samples`` is the stream of whole samples, the table that ``stream_samples`` writes: one query cannot
    hold a keyed state behind an aggregate. Read it without a limit of files per trigger, so that what one batch
    wrote is seen whole. The state of a session is its last sample. ``limits`` is a static table of
    connection limits. A pair without elapsed time gives no row.
    """
    carried = ["t", *COUNTERS]
    chunk = chunk_of(F.col("t"), chunk_seconds)
    paired = stream_look_back(samples, ["server", "session"], SAMPLE_ORDER, chunk, carried, idle)
    dt = F.col("t") - F.col("prev_t")
    return metrics_of_pairs(paired.withColumn("dt", dt).where(F.col("dt") > 0), limits)


# ---------------------------------------------------------------- alerts

ALERT_OUTPUT = (
    "server string, session string, rule_id int, t double, at_ms long, rule string, "
    "transition string, value double"
)
ALERT_STATE = "breach_since double, firing boolean"
# What a chunk tells its key: the rows of its opening breach that may fire, the first row without
# breach, and the state after its last row as far as the chunk itself knows it.
_BORDER_FIELDS = [
    ("server", pa.string()), ("session", pa.string()), ("rule_id", pa.int32()), ("t", pa.float64()), ("wall_ms", pa.int64()),
    ("rule", pa.string()), ("hold", pa.float64()), ("last_ms", pa.int64()), ("lead_t", pa.list_(pa.float64())),
    ("lead_ms", pa.list_(pa.int64())), ("lead_value", pa.list_(pa.float64())),
    ("reset_t", pa.float64()), ("reset_ms", pa.int64()), ("reset_value", pa.float64()),
    ("exit_since", pa.float64()), ("exit_firing", pa.bool_()),
]
ALERT_BORDER = pa.schema(_BORDER_FIELDS)


def _chunks(table: pa.Table) -> Iterator[tuple]:
    """(first row, t, breach, place of the first row without breach, hold) of each chunk of a sorted bucket."""
    table, starts = in_order(table, STATE_KEYS, SAMPLE_ORDER)
    t, breach = table.column("t").to_numpy(), table.column("breach").to_numpy()
    hold = np.maximum(table.column("for_secs").to_numpy(), 0.0)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        clear = np.flatnonzero(~breach[a:b])
        yield table, a, t[a:b], breach[a:b], int(clear[0]) if clear.size else b - a, float(hold[a])


def _holds(t: np.ndarray, breach: np.ndarray, hold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, fired, end) of each breach run; ``fired`` is ``end`` where it never lasted."""
    edges = np.diff(np.concatenate([[0], breach.view(np.int8), [0]]))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    held = breach & (t - t[start[np.maximum(np.searchsorted(start, np.arange(t.size), "right") - 1, 0)]] >= hold if start.size else False)
    first = np.append(np.flatnonzero(held), t.size)
    fired = np.minimum(first[np.searchsorted(first, start)], end)
    return start, fired, end


def _alerts_inside(table: pa.Table) -> pa.Table:
    """Transitions of a chunk after its first row without breach, which do not depend on the past."""
    places, kinds = [np.zeros(0, np.int64)], []
    for table, a, t, breach, clear, hold in _chunks(table):  # noqa: B020
        _, fired, end = _holds(t[clear:], breach[clear:], hold)
        lasted = fired < end
        left = lasted & (end < t.size - clear)
        places += [fired[lasted] + a + clear, end[left] + a + clear]
        kinds += ["fired"] * int(lasted.sum()) + ["resolved"] * int(left.sum())
    rows = table.take(pa.array(np.concatenate(places)))
    return pa.table(
        {
            **{k: rows.column(k) for k in STATE_KEYS},
            "t": rows.column("t"),
            "at_ms": rows.column("wall_ms"),
            "rule": rows.column("rule"),
            "transition": pa.array(kinds, pa.string()),
            "value": rows.column("value"),
        }
    )


def _alerts_border(table: pa.Table) -> pa.Table:
    found = []
    for table, a, t, breach, clear, hold in _chunks(table):  # noqa: B020
        ms = table.column("wall_ms").slice(a, t.size).to_numpy()
        value = table.column("value").slice(a, t.size).to_numpy()
        # The past can only have begun the breach earlier, so nothing after this row can be the one that fires.
        lead = min(int(np.searchsorted(t[:clear] - t[0] >= hold, True)) + 1, clear) if clear else 0
        start, fired, end = _holds(t[clear:], breach[clear:], hold)
        open_run = bool(start.size) and end[-1] == t.size - clear
        reset = {"reset_t": None, "reset_ms": None, "reset_value": None}
        if clear < t.size:
            reset = {"reset_t": t[clear], "reset_ms": ms[clear], "reset_value": value[clear]}
        found.append(
            {
                **{k: table.column(k)[a].as_py() for k in STATE_KEYS},
                "t": t[0],
                "wall_ms": ms[0],
                "rule": table.column("rule")[a].as_py(),
                "hold": hold,
                "last_ms": ms.max(),
                "lead_t": t[:lead].tolist(),
                "lead_ms": ms[:lead].tolist(),
                "lead_value": value[:lead].tolist(),
                **reset,
                "exit_since": t[clear:][start[-1]] if open_run else None,
                "exit_firing": open_run and bool(fired[-1] < end[-1]),
            }
        )
    return pa.Table.from_pylist(found, schema=ALERT_BORDER)


def _alerts_over_borders(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state machine over chunks: one step for each."""
    if state.hasTimedOut:
        state.remove()
        return
    since, firing = state.get if state.exists else (None, False)
    found = []
    rows = frames_in_order(parts, SAMPLE_ORDER)
    for r in rows.itertuples(index=False):
        if len(r.lead_t):
            since = r.t if since is None else since
            held = np.asarray(r.lead_t) - since >= r.hold
            if not firing and held.any():
                k, firing = int(held.argmax()), True
                found.append((*key, r.lead_t[k], r.lead_ms[k], r.rule, "fired", r.lead_value[k]))
        if not pd.isna(r.reset_t):
            if firing:
                found.append((*key, r.reset_t, int(r.reset_ms), r.rule, "resolved", r.reset_value))
            since, firing = None if pd.isna(r.exit_since) else float(r.exit_since), bool(r.exit_firing)
    state.update((since, firing))
    keep_until(state, rows["last_ms"].max())
    yield pd.DataFrame(found, columns=[*STATE_KEYS, "t", "at_ms", "rule", "transition", "value"])


def stream_alerts(
    metrics: DataFrame, rules: list[Rule] | None = None, idle: str = IDLE, chunk_seconds: float = HOUR_SECONDS
) -> DataFrame:
    """Transitions of the hold-window rules as they happen.

    ``metrics`` is the stream form of ``(server, session, t, wall_ms, metric, value)``. A chunk's
    transitions after its first row without breach are its own; what its beginning means depends on the
    past, and that one row of each chunk goes through the state: when a breach began and whether it
    fired. A rule of a session that is silent for ``idle`` is forgotten.
    """
    flagged = (
        metrics.join(rules_table(metrics.sparkSession, rules), "metric")
        .where(F.col("enabled"))
        .select(
            *STATE_KEYS, "t", "wall_ms", "value", "for_secs",
            breached(F.col("value"), F.col("cmp"), F.col("threshold")).alias("breach"),
            describe_rule(F.col("metric"), F.col("cmp"), F.col("threshold"), F.col("for_secs")).alias("rule"),
        )
    )
    chunked = bucketed(flagged, STATE_KEYS, chunk_of(F.col("t"), chunk_seconds))
    inside = chunked.applyInArrow(_alerts_inside, ALERT_OUTPUT)
    borders = chunked.applyInArrow(_alerts_border, from_arrow_schema(ALERT_BORDER))
    timed = borders.withColumn(EVENT_TIME, F.timestamp_millis("wall_ms")).withWatermark(EVENT_TIME, idle)
    first = timed.groupBy(*STATE_KEYS).applyInPandasWithState(
        _alerts_over_borders, ALERT_OUTPUT, ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return inside.unionByName(first)


# ---------------------------------------------------------------- upsert

def stream_upsert(samples: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Continuously merge ``(server, metric, ts, value, seq)`` into the versioned store."""
    return (
        samples.writeStream.foreachBatch(lambda batch, _id: merge_samples(batch, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
