"""Exact row numbers for data of any size and skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import checkpoint


def number_rows(df: DataFrame, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``row_no`` (from 0) and ``row_count`` per group, by a total order.

    A window would sort a whole group in one task. Instead rows are range
    partitioned, which splits a big group over many tasks, and their place
    inside the partition is stored by a reliable checkpoint; after that the
    numbers only need the row counts of the pieces in front.
    """
    keys = [*groups, *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = checkpoint(placed).withColumn("_part", F.shiftright("_place", 33))
    pieces = stored.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    # At most one piece per partition and group border.
    group = Window.partitionBy(*groups)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_part",
        *groups,
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(group).alias("row_count"),
    )
    # A group may be NULL, and keeps its rows.
    renamed = offsets.withColumnsRenamed({"_part": "p_part", **{g: f"p_{g}" for g in groups}})
    same = F.col("_part") == F.col("p_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"p_{g}"))
    return stored.join(renamed, same).select(
        *df.columns, (F.col("_offset") + F.col("_place") - F.col("_first")).alias("row_no"), "row_count"
    )
