"""Index advisor: findings from catalogue, usage and workload snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed, fmt_duration, one_line, short_digest
from tidewatch.operators.digests import RATIO_LIMIT, examined_per_sent
from tidewatch.operators.indexes import TABLE, proper_prefixes
from tidewatch.operators.suggest import statement_shapes
from tidewatch.sources.snapshots import newest

# Fixed values.
MIN_UPTIME_SECS = 7 * 24 * 3600
MIN_EXECUTIONS = 10
BIG_SCAN_ROWS = 10_000
BIG_TABLE_ROWS = 100_000
SEVERITIES = ["info", "warn", "high"]

FINDING = ["server", "severity", "kind", "object", "detail", "action"]


def drop_index_action(invisible: Column, schema: Column, table: Column, index: Column) -> Column:
    """Statement that drops an index, hiding it first where the server can."""
    alter = F.concat(F.lit("ALTER TABLE `"), schema, F.lit("`.`"), table, F.lit("` "))
    drop = F.concat(alter, F.lit("DROP INDEX `"), index, F.lit("`;"))
    hide = F.concat(alter, F.lit("ALTER INDEX `"), index, F.lit("` INVISIBLE;\n"))
    note = F.lit("-- watch for regressions, then:\n")
    return F.when(F.coalesce(invisible, F.lit(False)), F.concat(hide, note, drop)).otherwise(drop)


def _dotted(*cols: str) -> Column:
    return F.concat_ws(".", *[F.col(c) for c in cols])


def _listed(columns: Column) -> Column:
    return F.array_join(columns, ", ")


def redundant_indexes(defs: DataFrame, capabilities: DataFrame, strict: bool = False) -> DataFrame:
    """Indexes another index of the same table makes superfluous.

    No index is ever paired with each of its peers. Longer indexes are first
    reduced to the best cover per leftmost part; equal ones look at the next
    name in order, inside groups the engine limits to 64 indexes per table. A
    unique index is only covered by a unique one. Of two equal indexes the
    lower name is reported; ``strict`` instead reports the weaker one.
    """
    cover = F.struct(F.col("index"), F.col("columns"))
    longer = (
        proper_prefixes(defs)
        .groupBy(*TABLE, F.col("prefix").alias("columns"))
        .agg(
            F.min(cover).alias("longer_any"),
            F.min(F.when(F.col("unique"), cover)).alias("longer_unique"),
        )
    )
    twins = Window.partitionBy(*TABLE, "columns")
    later = twins.orderBy("index").rowsBetween(1, Window.unboundedFollowing)
    unique_twin = F.when(F.col("unique"), cover)
    is_primary = F.upper("index") == "PRIMARY"
    with_twins = defs.withColumns(
        {
            "twin_any": F.first(cover).over(later),
            "twin_unique": F.first(unique_twin, ignorenulls=True).over(later),
            "stronger": F.when(~F.col("unique"), F.min(unique_twin).over(twins)).when(
                ~is_primary, F.min(F.when(is_primary, cover)).over(twins)
            ),
        }
    )
    any_b = [F.col("longer_any"), F.col("twin_any")]
    unique_b = [F.col("longer_unique"), F.col("twin_unique")]
    if strict:
        any_b.append(F.col("stronger"))
        unique_b.append(F.col("stronger"))

    def best(options: list[Column]) -> Column:
        return F.array_min(F.array_compact(F.array(*options)))

    covered = (
        with_twins.where(~is_primary)
        .join(longer, [*TABLE, "columns"], "left")
        .withColumn("b", F.when(F.col("unique"), best(unique_b)).otherwise(best(any_b)))
        .where(F.col("b").isNotNull())
        .join(capabilities.select("server", "invisible_index"), "server", "left")
    )
    twin = F.size("b.columns") == F.size("columns")
    return covered.select(
        "server",
        F.when(twin, F.lit("high")).otherwise(F.lit("warn")).alias("severity"),
        F.when(twin, F.lit("duplicate index")).otherwise(F.lit("redundant index")).alias("kind"),
        _dotted("schema", "table", "index").alias("object"),
        F.concat(
            F.lit("("), _listed(F.col("columns")), F.lit(") is the start of `"), F.col("b.index"),
            F.lit("` ("), _listed(F.col("b.columns")), F.lit(")"),
        ).alias("detail"),
        drop_index_action(
            F.col("invisible_index"), F.col("schema"), F.col("table"), F.col("index")
        ).alias("action"),
    )


def unused_indexes(
    usage: DataFrame, defs: DataFrame, uptimes: DataFrame, capabilities: DataFrame
) -> DataFrame:
    """Indexes nobody read in at least a week; unique ones enforce something."""
    idle = newest(usage).where((F.col("reads") == 0) & (F.upper("index") != "PRIMARY"))
    old_enough = uptimes.where(F.col("uptime_s") >= MIN_UPTIME_SECS)
    known = defs.select(*TABLE, "index", "unique", F.lit(True).alias("defined"))
    joined = (
        idle.join(old_enough, "server")
        .join(known, [*TABLE, "index"], "left")
        .where(~F.coalesce(F.col("unique"), F.lit(False)))
        .join(capabilities.select("server", "invisible_index"), "server", "left")
    )
    return joined.select(
        "server",
        F.lit("warn").alias("severity"),
        F.lit("unused index").alias("kind"),
        _dotted("schema", "table", "index").alias("object"),
        F.concat(
            F.lit("0 reads, "), F.col("writes").cast("string"), F.lit(" writes in "),
            fmt_duration(F.col("uptime_s")), F.lit(" of uptime"),
        ).alias("detail"),
        F.when(
            F.col("defined"),
            drop_index_action(
                F.col("invisible_index"), F.col("schema"), F.col("table"), F.col("index")
            ),
        ).alias("action"),
    )


def scan_findings(scans: DataFrame) -> DataFrame:
    return scans.select(
        "server",
        F.when(F.col("table_rows") > BIG_SCAN_ROWS, F.lit("high")).otherwise(F.lit("info")).alias("severity"),
        F.lit("full table scan").alias("kind"),
        _dotted("schema", "table").alias("object"),
        F.concat(
            F.col("rows_full_scanned").cast("string"), F.lit(" reads without an index of ~"),
            F.col("table_rows").cast("string"), F.lit(" rows"),
        ).alias("detail"),
        F.lit(None).cast("string").alias("action"),
    )


def missing_pk_findings(no_pk: DataFrame) -> DataFrame:
    return no_pk.select(
        "server",
        F.when(F.col("table_rows") > BIG_TABLE_ROWS, F.lit("high")).otherwise(F.lit("warn")).alias("severity"),
        F.lit("no primary key").alias("kind"),
        _dotted("schema", "table").alias("object"),
        F.concat(
            F.col("engine"), F.lit(" table of ~"), F.col("table_rows").cast("string"),
            F.lit(" rows without a primary key"),
        ).alias("detail"),
        F.lit(None).cast("string").alias("action"),
    )


def _digest_object() -> Column:
    tail = F.concat(F.lit("digest "), short_digest(F.col("digest")))
    return F.when(F.col("schema") == "", tail).otherwise(F.concat(F.col("schema"), F.lit(" · "), tail))


def statement_findings(digests: DataFrame) -> DataFrame:
    """Up to three findings per digest that has run often enough."""
    text = F.lit(" — ")
    ratio = examined_per_sent()

    def finding(when: Column, severity: str, kind: str, detail: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.alias("detail")
            ),
        )

    found = F.array_compact(
        F.array(
            finding(
                F.col("no_index_used") > 0,
                "high",
                "statement without index",
                F.concat(
                    F.col("no_index_used").cast("string"), F.lit(" of "),
                    F.col("count").cast("string"), F.lit(" executions without an index"),
                    text, one_line(F.col("text"), 120),
                ),
            ),
            finding(
                (ratio > RATIO_LIMIT) & (F.col("rows_examined") > 0),
                "warn",
                "low selectivity",
                F.concat(
                    fixed(ratio, 0), F.lit(" rows examined per row sent"),
                    text, one_line(F.col("text"), 120),
                ),
            ),
            finding(
                F.col("tmp_disk_tables") > 0,
                "warn",
                "temp table on disk",
                F.concat(
                    F.col("tmp_disk_tables").cast("string"), F.lit(" temporary tables on disk"),
                    text, one_line(F.col("text"), 100),
                ),
            ),
        )
    )
    return (
        newest(digests).where(F.col("count") >= MIN_EXECUTIONS)
        .select("server", _digest_object().alias("object"), F.explode(found).alias("f"))
        .select(
            "server", "f.severity", "f.kind", "object", "f.detail",
            F.lit(None).cast("string").alias("action"),
        )
    )


def function_on_column(digests: DataFrame) -> DataFrame:
    """Columns a predicate wraps in a function, which no plain index serves."""
    shaped = statement_shapes(newest(digests).where(F.col("count") >= MIN_EXECUTIONS))
    return shaped.select(
        "server", "text", "shape.table", F.explode("shape.wrapped_columns").alias("column")
    ).select(
        "server",
        F.lit("warn").alias("severity"),
        F.lit("function on column").alias("kind"),
        _dotted("table", "column").alias("object"),
        F.concat(
            F.lit("a function around `"), F.col("column"), F.lit("` rules out its index"),
            F.lit(" — "), one_line(F.col("text"), 110),
        ).alias("detail"),
        F.lit(None).cast("string").alias("action"),
    )


def advise(*findings: DataFrame) -> DataFrame:
    """All findings, most severe first."""
    out = findings[0].select(*FINDING)
    for f in findings[1:]:
        out = out.unionByName(f.select(*FINDING))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return out.orderBy(F.desc(rank), "object", "server", "kind", "detail")


def finding_kinds(findings: DataFrame) -> DataFrame:
    return findings.select("kind").distinct().orderBy("kind")


def count_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("server", "severity").agg(F.count(F.lit(1)).alias("findings"))


def filter_findings(findings: DataFrame, kind: str | None = None) -> DataFrame:
    return findings if kind is None else findings.where(F.col("kind") == kind)
