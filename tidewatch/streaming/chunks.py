"""Looking back in a stream without holding a key's backlog in one frame.

Within a micro-batch each key is cut into time chunks, as ``operators.timeline`` does in batch. Rows look back inside
their own chunk; what passes a chunk border is one row for each (key, chunk), and only these
rows go through the keyed state. Chunks, not keys, are dealt to buckets by hash, so a key's backlog is spread over all
of them, and a frame is one bucket of a batch: some thousandth of its rows, and at least one chunk, which is
3,600 seconds of at most five polls a second.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

HOUR_SECONDS = 3_600
#: Groups of chunks in a micro-batch.
BUCKETS = 1024
EVENT_TIME = "event_time"
CHUNK = "_chunk"


def bucketed(rows: DataFrame, keys: Sequence[str], chunk: Column):
    """Rows with their chunk, grouped into buckets of whole (key, chunk)s."""
    chunked = rows.withColumn(CHUNK, chunk)
    return chunked.groupBy(F.pmod(F.xxhash64(*keys, CHUNK), F.lit(BUCKETS)).alias("_bucket"))


def in_order(table: pa.Table, keys: Sequence[str], order: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """A bucket by key, chunk and order, and where each (key, chunk) begins; its end is appended."""
    groups = [*keys, CHUNK]
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*groups, *order)]))
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in groups:
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return table, np.append(np.flatnonzero(new), table.num_rows)


def frames_in_order(parts: Iterable[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """One key's summaries of one micro-batch: a row for each chunk."""
    return pd.concat(list(parts), ignore_index=True).sort_values(list(order), kind="stable")


def keep_until(state: GroupState, newest_ms: int) -> None:
    """The state goes once the watermark, which trails by the idle time, passes the key's last row."""
    state.setTimeoutTimestamp(max(int(newest_ms) + 1, state.getCurrentWatermarkMs() + 1))


def stream_look_back(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    previous: Sequence[str],
    idle: str,
) -> DataFrame:
    """``rows`` with ``prev_<c>`` of the row before it, for each ``c`` of ``previous``.

    The first row of a key has no row before it and is left out, as is the first after the key was silent for ``idle``.
    ``order`` sorts a key's rows and holds ``wall_ms``; a row that comes in a later batch than its
    successors follows the last one seen. Rows later than ``idle`` count as lost.
    """
    names = rows.columns
    by_name = {f.name: f for f in rows.schema.fields}
    before = [StructField(f"prev_{c}", by_name[c].dataType) for c in previous]
    after = [StructField(f"last_{c}", by_name[c].dataType) for c in previous]
    newest = StructField("last_ms", LongType())

    def inside(table: pa.Table) -> pa.Table:
        table, starts = in_order(table, keys, order)
        later = np.ones(table.num_rows, bool)
        later[starts[:-1]] = False
        at = np.flatnonzero(later)
        return _widened(table.select(names).take(at), {f"prev_{c}": table.column(c).take(at - 1) for c in previous})

    def border(table: pa.Table) -> pa.Table:
        table, starts = in_order(table, keys, order)
        ends = starts[1:] - 1
        last = {f"last_{c}": table.column(c).take(ends) for c in previous}
        return _widened(table.select(names).take(starts[:-1]), last | {"last_ms": table.column("wall_ms").take(ends)})

    def over_borders(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = frames_in_order(parts, order)
        last = found[[f.name for f in after]]
        carried = last.shift().astype(object)
        known = state.exists
        if known:
            carried.iloc[0] = pd.Series(state.get, index=carried.columns, dtype=object)
        out = found[names].copy()
        for b, a in zip(before, after):
            out[b.name] = carried[a.name].to_numpy()
        state.update(tuple(_plain(v) for v in last.iloc[-1]))
        keep_until(state, found["last_ms"].max())
        yield out if known else out.iloc[1:]

    chunked = bucketed(rows, keys, chunk)
    pairs_schema = StructType([*rows.schema.fields, *before])
    pairs = chunked.applyInArrow(inside, pairs_schema)
    borders = chunked.applyInArrow(border, StructType([*rows.schema.fields, *after, newest]))
    timed = borders.withColumn(EVENT_TIME, F.timestamp_millis("wall_ms")).withWatermark(EVENT_TIME, idle)
    first = timed.groupBy(*keys).applyInPandasWithState(
        over_borders, pairs_schema, StructType(after), "append", GroupStateTimeout.EventTimeTimeout
    )
    return pairs.unionByName(first)


def _widened(table: pa.Table, columns: dict) -> pa.Table:
    for name, column in columns.items():
        table = table.append_column(name, column)
    return table


def _plain(value):
    """A state value as Spark takes it: NaN of an absent decimal is None, numpy scalars are Python's."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value
