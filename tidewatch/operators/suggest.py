"""Composite-index suggestions from the workload.

Digests are merged by the index they ask for before any index is looked at,
so the joins see one row per proposal, not one per statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.binding import pinned
from tidewatch.operators.digests import examined_per_sent
from tidewatch.operators.distinct_texts import HASH, parse_once
from tidewatch.operators.shapes import candidate_index, statement_shape
from tidewatch.sources.snapshots import newest

# Fixed values.
MIN_EXECUTIONS = 10
SHOWN_STATEMENTS = 3
IMPACTS = ["Low", "Medium", "High"]

PROPOSAL = ["server", "schema", "table", "key"]


def impact_rank() -> Column:
    """0 low, 1 medium, 2 high, from the digest's own counters."""
    ratio = examined_per_sent()
    scans = F.col("no_index_used") > 0
    often = F.col("count") >= 100
    total = F.col("total_ms")
    return (
        F.when((scans & often) | (ratio >= 1000.0) | (total >= 60_000.0), 2)
        .when(scans | (ratio >= 100.0) | often | (total >= 5_000.0), 1)
        .otherwise(0)
    )


def impact_label(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in IMPACTS]), rank)


def estimate_impact(digests: DataFrame) -> DataFrame:
    return digests.withColumn("impact", impact_label(impact_rank()))


def statement_shapes(digests: DataFrame) -> DataFrame:
    """Digests with their shape and its ``candidate`` index; NULL where the statement cannot be judged.

    A text is parsed once, however many servers and snapshots report it.
    """

    def parsed(texts: DataFrame) -> DataFrame:
        shaped = pinned(texts, "shape", statement_shape(F.col("sql")))
        return shaped.select(HASH, "sql", "shape", candidate_index(F.col("shape")).alias("candidate"))

    return parse_once(digests.withColumn("sql", F.coalesce("digest_text", "text")), "sql", parsed)


def _lower(columns: Column) -> Column:
    return F.transform(columns, F.lower)


def proposals(digests: DataFrame, min_executions: int = MIN_EXECUTIONS) -> DataFrame:
    """Digests with the index their shape wants and where it would go."""
    shaped = statement_shapes(newest(digests).where(F.col("count") >= min_executions)).withColumnRenamed("candidate", "columns")
    schema = F.coalesce(F.col("shape.schema"), F.nullif(F.col("schema"), F.lit("")))
    return (
        shaped.where(F.col("shape").isNotNull())
        .select(
            "server",
            "digest",
            F.coalesce(F.col("digest_text"), F.col("text")).alias("text"),
            "count",
            "total_ms",
            impact_rank().alias("impact"),
            schema.alias("schema"),
            F.col("shape.table").alias("table"),
            "columns",
        )
        .where((F.size("columns") > 0) & (F.coalesce(F.col("schema"), F.lit("")) != ""))
        .withColumn("key", _lower(F.col("columns")))
    )


def merge_proposals(asked: DataFrame) -> DataFrame:
    """One row per proposed index with the statements that asked for it."""
    worst_first = Window.partitionBy(*PROPOSAL).orderBy(F.desc("total_ms"), "digest", "text")
    top = (
        asked.select(*PROPOSAL, "total_ms", "digest", "text")
        .withColumn("n", F.row_number().over(worst_first))
        .where(F.col("n") <= SHOWN_STATEMENTS)
        .groupBy(*PROPOSAL)
        .agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("shown"))
    )
    rank = F.struct((-F.col("total_ms")).alias("t"), F.col("digest"), F.col("text"))
    merged = asked.groupBy(*PROPOSAL).agg(
        F.min_by("columns", rank).alias("columns"),
        F.max("impact").alias("impact"),
        F.sum("count").alias("executions"),
        F.sum("total_ms").alias("total_ms"),
    )
    return merged.join(top, PROPOSAL).select(
        *PROPOSAL,
        "columns",
        "impact",
        "executions",
        "total_ms",
        F.transform("shown", lambda s: s["text"]).alias("queries"),
    )


def _index_keys(defs: DataFrame) -> DataFrame:
    return defs.select(
        "server",
        F.lower("schema").alias("schema_key"),
        F.lower("table").alias("table_key"),
        _lower(F.col("columns")).alias("index_key"),
        "index",
    )


def _with_table_keys(merged: DataFrame) -> DataFrame:
    return merged.withColumns({"schema_key": F.lower("schema"), "table_key": F.lower("table")})


JOIN_KEYS = ["server", "schema_key", "table_key", "key"]


def drop_covered(merged: DataFrame, defs: DataFrame) -> DataFrame:
    """Proposals no existing index already starts with."""
    n = F.size("index_key")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.slice("index_key", F.lit(1), k)))
    served = _index_keys(defs).withColumn("key", F.explode(parts)).select(*JOIN_KEYS).distinct()
    return _with_table_keys(merged).join(served, JOIN_KEYS, "left_anti").select(*merged.columns)


def extends_index(merged: DataFrame, defs: DataFrame) -> DataFrame:
    """Adds ``extends``: an index the proposal would only lengthen.

    The proposal travels with its leading parts, so it is computed once.
    """
    existing = (
        _index_keys(defs)
        .groupBy("server", "schema_key", "table_key", F.col("index_key").alias("part"))
        .agg(F.min("index").alias("index"))
    )
    n = F.size("key")
    parts = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice("key", F.lit(1), k)))
    found = (
        _with_table_keys(merged.select(F.struct(*merged.columns).alias("row"), *PROPOSAL))
        .withColumn("part", F.explode_outer(parts))
        .join(existing, ["server", "schema_key", "table_key", "part"], "left")
        .groupBy(*PROPOSAL)
        .agg(F.any_value("row").alias("row"), F.min("index").alias("extends"))
    )
    return found.select("row.*", "extends")


def index_name(table: Column, columns: Column) -> Column:
    name = F.concat(F.lit("idx_"), table, F.lit("_"), F.array_join(columns, "_"))
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9_]", ""), 1, 64)


def index_ddl(schema: Column, table: Column, columns: Column, extends: Column) -> Column:
    """Online ALTER; extending an index replaces it in the same statement."""
    quoted = F.transform(
        columns, lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    )
    alter = F.concat(F.lit("ALTER TABLE `"), schema, F.lit("`.`"), table, F.lit("`\n"))
    add = F.concat(
        F.lit("  ADD INDEX `"), index_name(table, columns), F.lit("` ("),
        F.array_join(quoted, ", "), F.lit("),\n  ALGORITHM=INPLACE, LOCK=NONE;"),
    )
    replaced = F.concat(
        F.lit("-- extends the existing index `"), extends, F.lit("`\n"), alter,
        F.lit("  DROP INDEX `"), extends, F.lit("`,\n"), add,
    )
    return F.when(extends.isNotNull(), replaced).otherwise(F.concat(alter, add))


def columns_display(columns: Column) -> Column:
    return F.concat(F.lit("INDEX("), F.array_join(columns, ", "), F.lit(")"))


def suggest_indexes(
    digests: DataFrame, defs: DataFrame, min_executions: int = MIN_EXECUTIONS
) -> DataFrame:
    """Proposed indexes, strongest first."""
    merged = merge_proposals(proposals(digests, min_executions))
    return (
        extends_index(drop_covered(merged, defs), defs)
        .orderBy(F.desc("impact"), F.desc("total_ms"), "server", "schema", "table", "key")
        .select(
            "server",
            "schema",
            "table",
            "columns",
            impact_label(F.col("impact")).alias("impact"),
            "queries",
            "executions",
            "total_ms",
            "extends",
            index_name(F.col("table"), F.col("columns")).alias("index_name"),
            index_ddl(F.col("schema"), F.col("table"), F.col("columns"), F.col("extends")).alias("ddl"),
            columns_display(F.col("columns")).alias("columns_display"),
        )
    )
