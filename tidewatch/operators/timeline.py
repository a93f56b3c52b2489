"""Looking back along a timeline without putting a whole key in one task.

A window over ``(server, ...) order by t`` sorts everything one key owns in a
single task, so one busy server would hold the job up. Here each key is cut
into time chunks; the window runs per ``(key, chunk)``, and one small row per
chunk carries what the following chunk needs to know about its past. Results
are the same as those of the plain window.

Rows are shuffled once. Both the windows and the per-chunk rows read that one
exchange, so stacked look-backs do not compute their input again and again.

Width of a chunk: telemetry arrives at most every 200 ms, so a day of one
series is at most 432,000 rows, whatever the fleet looks like.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_SECONDS = 86_400
DAY_MILLIS = 86_400_000


def chunk_of(position: Column, width: float) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    previous: Mapping[str, Column] | None = None,
    last_known: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns taken from earlier rows of the same key.

    ``previous`` maps a new column to the expression to read on the row before
    (like ``lag``). ``last_known`` maps one to the newest non-NULL value of its
    expression on any earlier row; that expression may use the ``previous``
    columns. ``order`` must be a total order within a key. Key columns may hold
    NULLs, which count as equal.
    """
    previous = dict(previous or {})
    last_known = dict(last_known or {})
    rest = [c for c in df.columns if c not in keys]

    # Key and row travel as two structs. Keys with NULLs then compare like any
    # other, and both readers of the exchange want the same columns, which is
    # what lets Spark run it once.
    read = F.struct(F.lit(1).alias("_"), *[e.alias(n) for n, e in previous.items()])
    staged = df.select(
        F.struct(*keys).alias("_key"),
        chunk.alias("_chunk"),
        F.struct(*rest, read.alias("_read")).alias("_row"),
    ).repartition("_key", "_chunk")

    place = [f"_order_{c}" for c in order]
    staged = staged.withColumns({f"_order_{c}": F.col("_row")[c] for c in order})
    in_chunk = Window.partitionBy("_key", "_chunk").orderBy(*place)
    above = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumn("_prev", F.lag("_row").over(in_chunk)["_read"])
    position = F.struct(*place)
    summary = [F.max_by("_row", position).alias("_last"), F.min_by("_row", position).alias("_first")]
    if last_known:
        # A chunk's first row does not know its predecessor yet: its marks wait.
        opened = local.select(
            "_key", "_chunk", "_row", *place, "_prev", "_row.*",
            *[F.col("_prev")[n].alias(n) for n in previous],
        )
        local = opened.select(
            "_key", "_chunk", "_row", *place, "_prev",
            *[F.when(F.col("_prev").isNotNull(), e).alias(mark_name(n)) for n, e in last_known.items()],
        )
        for n in last_known:
            mark = F.col(mark_name(n))
            summary.append(F.max_by(mark, F.when(mark.isNotNull(), position)).alias(mark_name(n)))
    chunks = local.groupBy("_key", "_chunk").agg(*summary)

    over_chunks = Window.partitionBy("_key").orderBy("_chunk")
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_carry", F.lag("_last").over(over_chunks)["_read"])
    marks = [mark_name(n) for n in last_known]
    chunks = chunks.select(
        "_key", "_chunk", "_carry", "_first.*", *marks, *[F.col("_carry")[n].alias(n) for n in previous]
    ).withColumns({f"_open_{n}": e for n, e in last_known.items()})
    carried = chunks.select(
        F.col("_key").alias("_k"),
        F.col("_chunk").alias("_c"),
        "_carry",
        *[f"_open_{n}" for n in last_known],
        *[
            F.last(F.coalesce(mark_name(n), f"_open_{n}"), ignorenulls=True)
            .over(earlier)
            .alias(f"_past_{n}")
            for n in last_known
        ],
    )

    local = local.select(
        "_key", "_chunk", "_row", "_prev",
        *[F.last(mark_name(n), ignorenulls=True).over(above).alias(f"_near_{n}") for n in last_known],
    )
    same_chunk = (F.col("_key") == F.col("_k")) & (F.col("_chunk") == F.col("_c"))
    back = F.coalesce(F.col("_prev"), F.col("_carry"))

    def known(n: str) -> Column:
        inside = F.when(F.col("_prev").isNotNull(), F.coalesce(f"_near_{n}", f"_open_{n}"))
        return F.coalesce(inside, F.col(f"_past_{n}"))

    return local.join(carried, same_chunk, "left").select(
        *[F.col("_key" if c in keys else "_row")[c].alias(c) for c in df.columns],
        *[back[n].alias(n) for n in previous],
        *[known(n).alias(n) for n in last_known],
    )


def mark_name(column: str) -> str:
    return f"_mark_{column}"
