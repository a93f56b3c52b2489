"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` computed once per row.

    A column used several times in an expression is otherwise copied into it
    as often, and copies of copies multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``name``, computed once however many later steps read it.

    Going through ``explode`` of one element keeps the optimizer from copying
    the expression into each later projection and filter.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
