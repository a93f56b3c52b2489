"""Ordered row changes: preview, validation and application as one batch.

A change log is ``(seq, op, key, values)`` with ``op`` one of ``update``,
``delete``, ``insert`` and both others arrays of ``(column, value)`` text pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators.timeline import chunk_of, look_back

PAIRS = "array<struct<column:string,value:string>>"
CHANGE_LOG = f"seq bigint, op string, key {PAIRS}, values {PAIRS}"

# A key that changes very often is folded in pieces of this many log entries.
SEQ_CHUNK = 100_000

DUPLICATE = "duplicate key"


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def _literal(value: Column) -> Column:
    text = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def change_preview(schema: Column, table: Column) -> Column:
    """The statement a change stands for, with its values in place."""
    target = F.concat(_quoted(schema), F.lit("."), _quoted(table))
    key, values = F.col("key"), F.col("values")
    where = F.array_join(
        F.transform(key, lambda k: F.concat(_quoted(k["column"]), F.lit(" <=> "), _literal(k["value"]))),
        " AND ",
    )
    assign = F.array_join(
        F.transform(values, lambda v: F.concat(_quoted(v["column"]), F.lit(" = "), _literal(v["value"]))),
        ", ",
    )
    names = F.array_join(F.transform(values, lambda v: _quoted(v["column"])), ", ")
    literals = F.array_join(F.transform(values, lambda v: _literal(v["value"])), ", ")
    op = F.col("op")
    no_key = F.coalesce(F.size(key), F.lit(0)) <= 0
    return (
        F.when(
            op.isin("update", "delete") & no_key,
            F.concat(F.lit("-- refusing to "), F.upper(op), F.lit(" without a primary key")),
        )
        .when(
            op == "update",
            F.concat(F.lit("UPDATE "), target, F.lit(" SET "), assign, F.lit(" WHERE "), where, F.lit(" LIMIT 1")),
        )
        .when(op == "delete", F.concat(F.lit("DELETE FROM "), target, F.lit(" WHERE "), where, F.lit(" LIMIT 1")))
        .when((op == "insert") & (F.coalesce(F.size(values), F.lit(0)) <= 0), F.lit("-- nothing to insert"))
        .when(
            op == "insert",
            F.concat(F.lit("INSERT INTO "), target, F.lit(" ("), names, F.lit(") VALUES ("), literals, F.lit(")")),
        )
    )


def _keyed(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log entries with typed key columns ``k_*``, a value map and what is wrong with the entry itself."""
    pairs = F.map_from_entries(F.when(F.col("op") == "insert", F.col("values")).otherwise(F.col("key")))
    return (
        log.withColumn("_id", pairs)
        .withColumn("_set", F.map_from_entries("values"))
        .select(
            "seq",
            "op",
            "_id",
            "_set",
            *[F.try_element_at("_id", F.lit(k)).try_cast(base.schema[k].dataType).alias(f"k_{k}") for k in keys],
        )
        .withColumn("error", _malformed(base, keys))
    )


def _malformed(base: DataFrame, keys: Sequence[str]) -> Column:
    """Why an entry can never be applied, or NULL."""
    columns = F.array(*[F.lit(c) for c in base.columns])
    key_names = F.array(*[F.lit(k) for k in keys])
    given = F.coalesce(F.map_keys("_id"), F.array().cast("array<string>"))
    op = F.col("op")
    return (
        F.when(op.isNull() | ~op.isin("update", "delete", "insert"), F.lit("unknown operation"))
        .when(F.size(F.array_except(key_names, given)) > 0, F.lit("no primary key"))
        .when((op != "delete") & (F.coalesce(F.size("_set"), F.lit(0)) <= 0), F.lit("no values"))
        .when(
            (op != "delete") & F.exists(F.map_keys("_set"), lambda c: ~F.array_contains(columns, c)),
            F.lit("unknown column"),
        )
    )


def _traced(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each entry with whether its row exists at that point of the batch."""
    k_cols = [f"k_{k}" for k in keys]
    keyed = _keyed(base, log, keys)
    resets = F.when(F.col("op").isin("insert", "delete"), F.col("op"))
    traced = look_back(
        keyed, k_cols, ["seq"], chunk_of(F.col("seq"), SEQ_CHUNK), last_known={"_last_reset": resets}
    )
    present = base.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.lit(True).alias("_in_base"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"k_{k}").eqNullSafe(F.col(f"b_{k}"))
    return traced.join(present, same, "left").withColumn(
        "row_exists",
        F.when(F.col("_last_reset").isNotNull(), F.col("_last_reset") == "insert").otherwise(
            F.coalesce(F.col("_in_base"), F.lit(False))
        ),
    )


def change_errors(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries that would make the batch fail: ``(seq, op, error)``."""
    malformed = _keyed(base, log, keys).where(F.col("error").isNotNull())
    # Whether a row exists only ever changes by inserts and deletes, so the
    # updates, usually most of the log, stay out of the look back.
    op = F.col("op")
    resets = _traced(base, log.where(op.isin("insert", "delete")), keys)
    twice = resets.where((op == "insert") & F.col("row_exists")).withColumn("error", F.lit(DUPLICATE))
    out = ["seq", "op", "error"]
    return malformed.select(*out).unionByName(twice.select(*out))


def affected_rows(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows the batch matches, over all its entries."""
    hit = (F.col("op") == "insert") | F.col("row_exists")
    return _traced(base, log, keys).agg(F.count_if(hit).alias("affected"))


def _folded(base: DataFrame, log: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The log down to one row per key: its last effect, its first reset and its earliest error.

    Entries are shuffled once by key and piece of ``SEQ_CHUNK`` entries, so a key with very many changes is
    spread; the pieces of a key, one row each, then meet in order.
    """
    k_cols = [f"k_{k}" for k in keys]
    op = F.col("op")
    reset = op.isin("insert", "delete")
    entries = _keyed(base, log, keys).withColumn("_chunk", chunk_of(F.col("seq"), SEQ_CHUNK))
    before = Window.partitionBy(*k_cols, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("_before", F.last(F.when(reset, op), ignorenulls=True).over(before))

    def entry(when: Column, error: Column) -> Column:
        return F.when(when, F.struct("seq", "op", error.alias("error")))

    def last_write(c: str) -> Column:
        written = F.map_contains_key("_set", F.lit(c)) & (op != "delete")
        return F.max(F.when(written, F.struct("seq", F.try_element_at("_set", F.lit(c)).alias("value")))).alias(f"w_{c}")

    twice = (op == "insert") & (F.col("_before") == "insert")
    pieces = entries.groupBy(*k_cols, "_chunk").agg(
        F.min(entry(F.col("error").isNotNull(), F.col("error"))).alias("_bad"),
        F.min(entry(twice, F.lit(DUPLICATE))).alias("_twice"),
        F.min(F.when(reset, F.struct("seq", "op"))).alias("_first"),
        F.max(F.when(reset, F.struct("seq", "op"))).alias("_reset"),
        *[last_write(c) for c in rest],
    )
    earlier = Window.partitionBy(*k_cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_past", F.last("_reset", ignorenulls=True).over(earlier))
    border = (F.col("_first.op") == "insert") & (F.col("_past.op") == "insert")
    over_border = F.when(border, F.struct("_first.seq", "_first.op", F.lit(DUPLICATE).alias("error")))
    return pieces.groupBy(*k_cols).agg(
        F.min(F.least("_bad", "_twice", over_border)).alias("_error"),
        F.min("_first").alias("_first"),
        F.max("_reset").alias("_reset"),
        *[F.max(f"w_{c}").alias(f"w_{c}") for c in rest],
    )


def apply_changes(
    base: DataFrame, log: DataFrame, keys: Sequence[str], check: bool = True
) -> DataFrame:
    """The table after the whole batch.

    All or nothing: with ``check`` a bad entry fails the job that reads the result, whatever part of it is
    read, so nothing of it can be committed; the message names the earliest bad entry of its key. The
    log is read once and folded to its last effect per key, and then meets the table in
    one NULL-safe full outer join.
    """
    if not keys:
        raise ValueError("changes need a primary key")
    rest = [c for c in base.columns if c not in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    joined = base.withColumn("_in_base", F.lit(True)).join(_folded(base, log, keys, rest), same, "full_outer")

    reset_seq, reset_op = F.col("_reset.seq"), F.col("_reset.op")
    survives = F.when(F.col("_reset").isNotNull(), reset_op == "insert").otherwise(F.col("_in_base"))
    if check:
        known = F.when(
            F.col("_in_base") & (F.col("_first.op") == "insert"),
            F.struct("_first.seq", "_first.op", F.lit(DUPLICATE).alias("error")),
        )
        bad = F.least("_error", known)
        said = F.format_string("change %d (%s): %s", bad["seq"], F.coalesce(bad["op"], F.lit("?")), bad["error"])
        # In the condition, so that no reader of the result can leave it out.
        survives = F.when(bad.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(survives)

    def cell(c: str) -> Column:
        written = F.col(f"w_{c}")
        new = written["value"].cast(base.schema[c].dataType)
        counts = written.isNotNull() & (reset_seq.isNull() | (written["seq"] >= reset_seq))
        old = F.when(F.col("_reset").isNull(), F.col(c))
        return F.when(counts, new).otherwise(old).alias(c)

    return joined.where(survives).select(
        *[
            F.when(F.col("_in_base"), F.col(c)).otherwise(F.col(f"k_{c}")).alias(c) if c in keys else cell(c)
            for c in base.columns
        ]
    )
