"""Catalogue lists, paged browsing and grid order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import is_number, matches_needle
from tidewatch.operators.indexes import TABLE
from tidewatch.sources.snapshots import not_system

PAGE_ROWS = 500  # fixed value: rows a console or page shows


def list_schemas(tables: DataFrame) -> DataFrame:
    return (
        tables.where(not_system(F.col("schema")))
        .select("server", "schema")
        .distinct()
        .orderBy("server", "schema")
    )


def list_tables(tables: DataFrame, schema: str | None = None) -> DataFrame:
    if schema is not None:
        tables = tables.where(F.col("schema") == schema)
    return tables.select(
        *TABLE,
        F.coalesce(F.col("engine"), F.lit("")).alias("engine"),
        F.coalesce(F.col("table_rows"), F.lit(0)).cast("bigint").alias("table_rows"),
        F.coalesce(F.upper("table_type") == "VIEW", F.lit(False)).alias("is_view"),
    ).orderBy(*TABLE)


def filter_tables(tables: DataFrame, needle: str) -> DataFrame:
    return tables.where(matches_needle(needle, F.col("table"))) if needle else tables


def describe_table(columns: DataFrame, schema: str | None = None, table: str | None = None) -> DataFrame:
    if schema is not None:
        columns = columns.where(F.col("schema") == schema)
    if table is not None:
        columns = columns.where(F.col("table") == table)
    return columns.select(
        *TABLE,
        "ordinal",
        "column",
        F.coalesce(F.col("column_type"), F.lit("")).alias("column_type"),
        F.coalesce(F.upper("is_nullable") == "YES", F.lit(False)).alias("nullable"),
        F.coalesce(F.upper("column_key") == "PRI", F.lit(False)).alias("is_pk"),
        F.coalesce(F.col("extra"), F.lit("")).alias("extra"),
    ).orderBy(*TABLE, "ordinal")


def primary_key(described: DataFrame) -> DataFrame:
    """Key columns per table (at most 16) and whether rows can be edited."""
    in_key = F.when(F.col("is_pk"), F.struct("ordinal", "column"))
    return (
        described.groupBy(*TABLE)
        .agg(F.sort_array(F.collect_list(in_key)).alias("k"))
        .select(
            *TABLE,
            F.transform("k", lambda x: x["column"]).alias("primary_key"),
            (F.size("k") > 0).alias("is_editable"),
        )
    )


def equality_filter(column: str, value: str | None) -> Column:
    """``column = value`` or ``column IS NULL``; the value is never SQL text."""
    c = F.col(f"`{column.replace('`', '``')}`")
    return c.isNull() if value is None else c == F.lit(value)


def _filtered(df: DataFrame, condition: str | Column | None) -> DataFrame:
    if isinstance(condition, str):
        return df.where(F.expr(condition)) if condition.strip() else df
    return df if condition is None else df.where(condition)


def _page_order(tiebreak: Sequence[str], order_by: str | None, descending: bool) -> list[tuple[str, bool]]:
    """Sort columns and whether each runs downwards; the tie-break makes the order total."""
    first = [] if order_by is None else [(order_by, descending)]
    return [*first, *((c, False) for c in tiebreak if c != order_by)]


def _sorted(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def _first_rows(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    fetched = df.orderBy(*_sorted(order))
    fetched = (fetched.offset(offset) if offset else fetched).limit(limit + 1)
    # The windows below see one page, never the table.
    place = Window.orderBy(*_sorted(order))
    return (
        fetched.withColumn("_n", F.row_number().over(place))
        .withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(0))) > limit)
        .where(F.col("_n") <= limit)
        .drop("_n")
    )


def browse_page(
    df: DataFrame,
    tiebreak: Sequence[str],
    condition: str | Column | None = None,
    order_by: str | None = None,
    descending: bool = False,
    limit: int = PAGE_ROWS,
    offset: int = 0,
) -> DataFrame:
    """One page plus ``has_more``. ``tiebreak`` makes the order total, so that
    pages neither repeat nor skip rows.

    An offset makes every task hand over ``offset + limit`` rows; to go on from a page, ``browse_after`` needs
    one page of each.
    """
    return _first_rows(_filtered(df, condition), _page_order(tiebreak, order_by, descending), limit, offset)


def page_end(page: DataFrame, tiebreak: Sequence[str], order_by: str | None = None, descending: bool = False) -> dict | None:
    """Where a page ends: the sort values of its last row, or None for an empty page."""
    order = _page_order(tiebreak, order_by, descending)
    turned = [F.col(c).asc() if down else F.col(c).desc() for c, down in order]
    last = page.orderBy(*turned).select(*[c for c, _ in order]).first()
    return None if last is None else last.asDict()


def _beyond(column: str, kind, down: bool, value) -> Column:
    """Rows that sort after ``value``: NULL sorts first upwards and last downwards."""
    c = F.col(column)
    if value is None:
        return F.lit(False) if down else c.isNotNull()
    at = F.lit(value).cast(kind)
    return (c < at) | c.isNull() if down else c > at


def seek(df: DataFrame, order: Sequence[tuple[str, bool]], end: dict) -> DataFrame:
    """Rows after the position ``end`` in an order."""
    after, same = F.lit(False), F.lit(True)
    for column, down in order:
        kind = df.schema[column].dataType
        after = after | (same & _beyond(column, kind, down, end[column]))
        value = end[column]
        same = same & (F.col(column).isNull() if value is None else F.col(column) == F.lit(value).cast(kind))
    return df.where(after)


def browse_after(
    df: DataFrame,
    end: dict | None,
    tiebreak: Sequence[str],
    condition: str | Column | None = None,
    order_by: str | None = None,
    descending: bool = False,
    limit: int = PAGE_ROWS,
) -> DataFrame:
    """The page that follows a page's ``page_end``; without one the first page.

    The position is a filter, which reaches the scan, and each task hands over one page, however deep it is.
    """
    order = _page_order(tiebreak, order_by, descending)
    rows = _filtered(df, condition)
    return _first_rows(rows if end is None else seek(rows, order, end), order, limit)


def count_rows(df: DataFrame, condition: str | Column | None = None) -> DataFrame:
    return _filtered(df, condition).agg(F.count(F.lit(1)).alias("rows"))


def grid_order(column: str, descending: bool = False) -> list[Column]:
    """Sort expressions for a text column: NULLs, then numbers, then text."""
    c = F.col(column)
    number = F.when(is_number(c), c).try_cast("double")
    keys = [c.isNotNull(), number.isNull(), number, F.when(number.isNull(), c)]
    return [k.desc() if descending else k.asc() for k in keys]


def grid_sort(
    df: DataFrame, column: str, tiebreak: Sequence[str], descending: bool = False
) -> DataFrame:
    return df.orderBy(*grid_order(column, descending), *tiebreak)


def row_key(*columns: str) -> Column:
    """Primary-key columns of a row with their values as text."""
    return F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
