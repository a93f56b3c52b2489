"""Hold-window threshold alerts as gaps and islands.

A rule fires once its breach has lasted ``for_secs`` and resolves on the first
sample that does not breach. Per (server, session, rule) a *run* is a stretch
of equal breach flags; everything the state machine knows at a row follows from
the row before and from where the current run began.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed
from tidewatch.operators.rates import METRIC_LABELS
from tidewatch.operators.timeline import DAY_SECONDS, chunk_of, look_back

LOG_ROWS = 500  # fixed value: transitions kept in each server's log


@dataclass(frozen=True)
class Rule:
    rule_id: int
    metric: str
    cmp: str  # 'above' or 'below'
    threshold: float
    for_secs: float
    enabled: bool = True


RULE_SCHEMA = (
    "rule_id int, metric string, cmp string, threshold double, for_secs double, enabled boolean"
)

# The rules a new installation starts with.
DEFAULT_RULES = [
    Rule(1, "conn_usage_pct", "above", 80.0, 30.0),
    Rule(2, "threads_running", "above", 40.0, 15.0),
    Rule(3, "slow_qps", "above", 5.0, 30.0),
    Rule(4, "bp_hit_pct", "below", 95.0, 60.0),
    Rule(5, "table_lock_waits_s", "above", 1.0, 30.0),
    Rule(6, "tmp_disk_tables_s", "above", 5.0, 60.0),
    Rule(7, "aborted_connects_s", "above", 1.0, 30.0),
]

STATE_KEYS = ["server", "session", "rule_id"]


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rules = DEFAULT_RULES if rules is None else rules
    return spark.createDataFrame([astuple(r) for r in rules], RULE_SCHEMA)


def breached(value: Column, cmp: Column, threshold: Column) -> Column:
    """Strictly beyond the threshold. A NaN never is."""
    beyond = F.when(cmp == "above", value > threshold).otherwise(value < threshold)
    return F.coalesce(beyond & ~F.isnan(value), F.lit(False))


def describe_rule(metric: Column, cmp: Column, threshold: Column, for_secs: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv])
    whole = F.abs(threshold - threshold.cast("bigint")) < 1e-9
    return F.concat(
        F.coalesce(F.try_element_at(labels, metric), metric),
        F.when(cmp == "above", F.lit(" > ")).otherwise(F.lit(" < ")),
        F.when(whole, fixed(threshold, 0)).otherwise(fixed(threshold, 2)),
        F.lit(" for "),
        fixed(for_secs, 0),
        F.lit("s"),
    )


def evaluate_alerts(
    metrics: DataFrame, rules: list[Rule] | None = None, chunk_seconds: float = DAY_SECONDS
) -> DataFrame:
    """Every sample under every rule of its metric, with the state it leads to.

    ``metrics`` is ``(server, session, t, wall_ms, metric, value)``. A disabled
    rule stays ``ok`` without transitions; a new session starts from ``ok``.
    """
    table = rules_table(metrics.sparkSession, rules)
    joined = metrics.join(table, "metric").select(
        *STATE_KEYS, "t", "wall_ms", "metric", "cmp", "threshold", "for_secs", "value",
        (F.col("enabled") & breached(F.col("value"), F.col("cmp"), F.col("threshold"))).alias("breach"),
    )

    turned = F.when(F.col("breach") != F.coalesce("prev_breach", F.lit(False)), F.col("t"))
    runs = look_back(
        joined,
        STATE_KEYS,
        ["t", "wall_ms"],
        chunk_of(F.col("t"), chunk_seconds),
        previous={"prev_breach": F.col("breach"), "prev_t": F.col("t")},
        last_known={"earlier_turn": turned},
    )
    hold = F.greatest(F.col("for_secs"), F.lit(0.0))
    run_start = F.coalesce(turned, F.col("earlier_turn"))
    held = F.col("breach") & (F.col("t") - run_start >= hold)
    was_held = F.coalesce(
        F.col("prev_breach") & (F.col("prev_t") - F.col("earlier_turn") >= hold), F.lit(False)
    )
    return runs.select(
        *STATE_KEYS, "metric", "t", "wall_ms", "value", "breach",
        F.when(F.col("breach"), run_start).alias("breach_since"),
        F.when(held, F.lit("firing")).when(F.col("breach"), F.lit("pending"))
        .otherwise(F.lit("ok")).alias("status"),
        F.when(held & ~was_held, F.lit("fired"))
        .when(~F.col("breach") & was_held, F.lit("resolved")).alias("transition"),
        describe_rule(F.col("metric"), F.col("cmp"), F.col("threshold"), F.col("for_secs")).alias("rule"),
    )


def alert_transitions(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("transition").isNotNull()).select(
        *STATE_KEYS, "t", F.col("wall_ms").alias("at_ms"), "rule", "transition", "value"
    )


def alert_states(evaluated: DataFrame) -> DataFrame:
    """Latest state per server, session and rule.

    ``since`` is when a pending breach began or when a firing alert fired.
    """
    newest = F.struct("t", "wall_ms")
    last = evaluated.groupBy(*STATE_KEYS).agg(
        F.max_by(F.struct("status", "breach_since"), newest).alias("last"),
        F.max(F.when(F.col("transition") == "fired", F.col("t"))).alias("fired_t"),
        F.max_by("rule", newest).alias("rule"),
    )
    status = F.col("last.status")
    return last.select(
        *STATE_KEYS,
        "rule",
        status.alias("status"),
        F.when(status == "firing", F.col("fired_t"))
        .when(status == "pending", F.col("last.breach_since"))
        .alias("since"),
    )


def firing_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("server").agg(F.count_if(F.col("status") == "firing").alias("firing"))


def alert_log(evaluated: DataFrame, rows: int | None = LOG_ROWS) -> DataFrame:
    """The newest transitions, newest first: ``rows`` of each server, older ones are dropped; None keeps all."""
    found = alert_transitions(evaluated)
    if rows is not None:
        newest = Window.partitionBy("server").orderBy(F.desc("at_ms"), F.desc("t"), "session", "rule_id")
        found = found.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= rows).drop("_n")
    return found.orderBy(F.desc("at_ms"), F.desc("t"), "server", "session", "rule_id")
