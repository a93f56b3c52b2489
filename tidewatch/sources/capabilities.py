"""Server version text to feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = [
    "ps_processlist", "ps_data_locks", "innodb_trx", "statement_digest", "digest_sample_text",
    "sys_schema", "replica_terms", "innodb_metrics", "perf_schema_on", "metadata_locks",
    "history_long", "index_usage", "invisible_index",
]

# First version with a feature. None: never; (0,0,0): always.
ALWAYS = (0, 0, 0)
SINCE = {
    "ps_processlist": (8, 0, 22),
    "ps_data_locks": (8, 0, 0),
    "innodb_trx": (5, 6, 0),
    "statement_digest": (5, 6, 0),
    "digest_sample_text": (8, 0, 0),
    "sys_schema": (5, 7, 0),
    "replica_terms": (8, 0, 22),
    "innodb_metrics": (5, 6, 0),
    "perf_schema_on": None,
    "metadata_locks": (5, 7, 3),
    "history_long": (5, 6, 0),
    "index_usage": (5, 6, 0),
    "invisible_index": (8, 0, 13),
}
SINCE_MARIADB = {
    "ps_processlist": None,
    "ps_data_locks": None,
    "innodb_trx": ALWAYS,
    "statement_digest": ALWAYS,
    "digest_sample_text": None,
    "sys_schema": (10, 6, 0),
    "replica_terms": None,
    "innodb_metrics": ALWAYS,
    "perf_schema_on": None,
    "metadata_locks": (10, 5, 0),
    "history_long": ALWAYS,
    "index_usage": ALWAYS,
    "invisible_index": None,
}


def _part(version: Column, index: int) -> Column:
    head = F.regexp_extract(version, r"^[0-9.]*", 0)
    part = F.get(F.split(head, r"\."), F.lit(index))
    return F.coalesce(F.nullif(part, F.lit("")).try_cast("int"), F.lit(0))


def parse_version(servers: DataFrame) -> DataFrame:
    """Adds ``major, minor, patch, flavor``."""
    version = F.coalesce(F.col("version"), F.lit(""))
    hay = F.lower(F.concat(version, F.lit(" "), F.coalesce(F.col("version_comment"), F.lit(""))))
    major = _part(version, 0)
    return servers.withColumns(
        {
            "major": major,
            "minor": _part(version, 1),
            "patch": _part(version, 2),
            "flavor": F.when(F.contains(hay, F.lit("mariadb")), F.lit("MariaDB"))
            .when(F.contains(hay, F.lit("percona")), F.lit("Percona"))
            .when(major > 0, F.lit("MySQL"))
            .otherwise(F.lit("Unknown")),
        }
    )


def at_least(since: tuple[int, int, int] | None) -> Column:
    if since is None:
        return F.lit(False)
    if since == ALWAYS:
        return F.lit(True)
    have = F.struct("major", "minor", "patch")
    return have >= F.struct(*[F.lit(n).alias(k) for k, n in zip(("major", "minor", "patch"), since)])


def server_capabilities(servers: DataFrame, perf_schema_on: Column | None = None) -> DataFrame:
    """One row of flags per server. A server of unknown version gets none that
    a version grants; ``perf_schema_on`` is a run-time setting, off by default."""
    parsed = parse_version(servers)
    maria = F.col("flavor") == "MariaDB"
    flags = {
        f: F.when(maria, at_least(SINCE_MARIADB[f])).otherwise(at_least(SINCE[f])) for f in FLAGS
    }
    if perf_schema_on is not None:
        flags["perf_schema_on"] = perf_schema_on
    return parsed.withColumns(flags)


def capability_summary() -> Column:
    """Enabled features on one line."""
    shown = [
        (F.col("perf_schema_on"), "perf_schema"),
        (F.col("ps_processlist"), "ps.processlist"),
        (F.col("ps_data_locks"), "data_locks"),
        (~F.col("ps_data_locks"), "innodb_locks"),
        (F.col("statement_digest"), "digest"),
        (F.col("sys_schema"), "sys"),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in shown])), " · ")


# What a server must have for a reader to see anything.
METADATA_LOCKS = ["metadata_locks", "perf_schema_on"]
INDEX_USAGE = ["index_usage", "perf_schema_on"]


def gated(rows: DataFrame, capabilities: DataFrame, needs: list[str]) -> DataFrame:
    """``rows`` with ``supported``; a server that lacks a need has one row that says so and holds nothing else.

    A supporting server without rows has none, which is an empty answer, not a missing one. What a server
    without the feature reports nevertheless, and rows of servers that ``capabilities`` does not know, are left out.
    """
    has = F.lit(True)
    for flag in needs:
        has = has & F.coalesce(F.col(flag), F.lit(False))
    known = capabilities.select("server", has.alias("supported"))
    able = rows.join(known.where("supported"), "server")
    unable = known.where("NOT supported").dropDuplicates(["server"])
    return able.select(*rows.columns, "supported").unionByName(unable, allowMissingColumns=True)
