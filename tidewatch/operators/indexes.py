"""Index and table facts out of catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.capabilities import INDEX_USAGE, gated
from tidewatch.sources.snapshots import newest, not_system

TABLE = ["server", "schema", "table"]


def index_definitions(index_columns: DataFrame) -> DataFrame:
    """Ordered column list per index. An index has at most 16 columns, which
    bounds each collected list."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "column")))
    return (
        index_columns.where(not_system(F.col("schema")))
        .groupBy(*TABLE, "index")
        .agg(
            F.transform(ordered, lambda x: x["column"]).alias("columns"),
            (F.min("non_unique") == 0).alias("unique"),
        )
    )


def tables_without_pk(tables: DataFrame, constraints: DataFrame) -> DataFrame:
    base = tables.where((F.col("table_type") == "BASE TABLE") & not_system(F.col("schema")))
    keyed = constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(*TABLE)
    return base.join(keyed, TABLE, "left_anti").select(
        *TABLE,
        F.coalesce(F.col("table_rows"), F.lit(0)).cast("bigint").alias("table_rows"),
        F.coalesce(F.col("engine"), F.lit("")).alias("engine"),
    )


def full_table_scans(
    usage: DataFrame, tables: DataFrame, limit: int | None = None, capabilities: DataFrame | None = None
) -> DataFrame:
    """Tables read without an index: all of them, or for display the worst ``limit`` of each server.

    With ``capabilities`` servers that do not count index usage say so, see ``gated``.
    """
    top = newest(usage).where(F.col("index").isNull() & (F.col("reads") > 0) & not_system(F.col("schema")))
    if limit is not None:
        worst = Window.partitionBy("server").orderBy(F.desc("reads"), "schema", "table")
        top = top.withColumn("_n", F.row_number().over(worst)).where(F.col("_n") <= limit)
    sizes = tables.select(*TABLE, "table_rows")
    found = top.join(sizes, TABLE, "left").select(
        *TABLE,
        F.col("reads").alias("rows_full_scanned"),
        F.coalesce(F.col("table_rows"), F.lit(0)).cast("bigint").alias("table_rows"),
    )
    return found if capabilities is None else gated(found, capabilities, INDEX_USAGE)


def proper_prefixes(defs: DataFrame) -> DataFrame:
    """Every leftmost part of every index that is shorter than the index."""
    n = F.size("columns")
    lengths = F.when(n > 1, F.sequence(F.lit(1), n - 1))
    return defs.withColumn(
        "prefix", F.explode(F.transform(lengths, lambda k: F.slice("columns", F.lit(1), k)))
    )
