"""Statement-digest ranking, filters and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import matches_needle

# Fixed values.
TOP_DIGESTS = 100
WORST_STATEMENTS = 5
RATIO_LIMIT = 100.0


def examined_per_sent() -> Column:
    """Rows examined per row sent, or rows examined when none was sent."""
    examined = F.col("rows_examined").cast("double")
    sent = F.col("rows_sent").cast("double")
    return F.when(sent > 0, examined / sent).otherwise(examined)


def sort_keys() -> dict[str, Column]:
    """The six orders a digest list can have, all descending."""
    return {
        "total_time": F.col("total_ms"),
        "avg_time": F.col("avg_ms"),
        "max_time": F.col("max_ms"),
        "count": F.col("count").cast("double"),
        "rows_examined": F.col("rows_examined").cast("double"),
        "examined_ratio": examined_per_sent(),
    }


def rank_digests(digests: DataFrame, by: str = "total_time") -> DataFrame:
    keys = sort_keys()
    if by not in keys:
        raise ValueError(f"unknown sort key {by!r}; one of {sorted(keys)}")
    return digests.orderBy(F.desc(keys[by]), "server", "digest")


def top_per_server(digests: DataFrame, n: int, by: str = "total_time") -> DataFrame:
    """The ``n`` worst digests of each server, with their rank."""
    worst = Window.partitionBy("server").orderBy(F.desc(sort_keys()[by]), "digest")
    return digests.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= n)


def top_queries(
    digests: DataFrame, limit: int = TOP_DIGESTS, per_server: bool = True
) -> DataFrame:
    """Worst total time first, among digests the server still has the text of."""
    known = digests.where(F.col("digest_text").isNotNull())
    if per_server:
        return top_per_server(known, limit)
    return rank_digests(known).limit(limit)


def digest_detail(digests: DataFrame, digest: str) -> DataFrame:
    return digests.where(F.col("digest") == digest)


def filter_digests(digests: DataFrame, needle: str) -> DataFrame:
    hit = matches_needle(needle, F.col("text")) | matches_needle(needle, F.col("schema"))
    return digests.where(hit)


def worst_statements(digests: DataFrame, n: int = WORST_STATEMENTS) -> DataFrame:
    """The ``n`` slowest statements of each server, with their rank; all others are dropped."""
    return top_per_server(digests, n)


def digest_flags(digests: DataFrame) -> DataFrame:
    return digests.withColumns(
        {
            "examined_per_sent": examined_per_sent(),
            "high_ratio": examined_per_sent() > RATIO_LIMIT,
            "tmp_on_disk": F.col("tmp_disk_tables") > 0,
            "without_index": F.col("no_index_used") > 0,
        }
    )


def execution_flag() -> Column:
    """Label of one execution; the bad index outranks the missing one."""
    return F.when(F.col("no_good_index_used"), F.lit("no good index")).when(
        F.col("no_index_used"), F.lit("no index")
    )


def explainable(text: Column) -> Column:
    """A complete SELECT: no placeholders left in the text."""
    starts = F.lower(F.regexp_replace(text, r"(?U)^\s+", "")).startswith("select")
    return starts & ~F.contains(text, F.lit("?"))
