"""Work that depends on a text only, done once for each distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "_text_hash"


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text; a NULL text has its own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    """Each text once with its hash.

    Repeats go on the map side, so a text that fills the table ships one row per task. The shuffle spreads what
    follows over all tasks, also where the rows come from one file.
    """
    return rows.select(text_hash(F.col(text)).alias(HASH), text).distinct()


def parse_once(rows: DataFrame, text: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` without ``text``, with the columns that ``parse`` adds to the distinct texts.

    Rows whose text ``parse`` leaves out are left out. Texts are joined back by hash.
    """
    keyed = rows.withColumn(HASH, text_hash(F.col(text))).drop(text)
    return keyed.join(parse(distinct_texts(rows, text)).drop(text), HASH).drop(HASH)
