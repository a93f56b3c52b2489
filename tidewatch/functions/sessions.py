"""Session keys and connection-usage bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"

# Share of the connection limit, in percent.
USAGE_WARN_PCT = 70.0
USAGE_CRIT_PCT = 85.0


def is_sleeping(command: Column) -> Column:
    return F.lower(F.coalesce(command, F.lit(""))) == "sleep"


def user_key(user: Column) -> Column:
    return F.when(F.coalesce(user, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(user)


def host_key(host: Column) -> Column:
    """Host without its client port. Bare IPv6 addresses keep their colons."""
    bracketed = r"^\[([^\]]*)\]"
    with_port = r"^([^:]+):[0-9]+\z"
    return (
        F.when(F.coalesce(host, F.lit("")) == "", F.lit(UNKNOWN))
        .when(host.rlike(bracketed), F.regexp_extract(host, bracketed, 1))
        .when(host.rlike(with_port), F.regexp_extract(host, with_port, 1))
        .otherwise(host)
    )


def usage_pct(connected: Column, limit: Column) -> Column:
    return F.when(
        F.coalesce(limit.cast("double"), F.lit(0.0)) > 0,
        connected.cast("double") / limit.cast("double") * 100.0,
    ).otherwise(F.lit(0.0))


def usage_level(pct: Column) -> Column:
    return (
        F.when(pct >= USAGE_CRIT_PCT, F.lit("critical"))
        .when(pct >= USAGE_WARN_PCT, F.lit("warn"))
        .otherwise(F.lit("ok"))
    )
