"""Queries over the index advisor and the index suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import advisor as V
from tidewatch.operators import indexes as I
from tidewatch.operators import suggest as G
from tidewatch.plans.registry import query
from tidewatch.plans.queries_sources import FLAGGED
from tidewatch.plans.views import TEMPLATES, view, with_views
from tidewatch.sources.capabilities import server_capabilities
from tidewatch.sources.snapshots import read_index_usage, read_metadata_locks

# ------------------------------------------------------------- catalogue


def definitions(spark, sf):
    return I.index_definitions(view(spark, sf, "index_columns"))


def capabilities(spark, sf):
    """Of every fourth server the performance tables are switched off."""
    number = F.substring("server", 2, 20).cast("bigint")
    caps = server_capabilities(view(spark, sf, "servers"), perf_schema_on=number % 4 != 3)
    return caps.withColumn("server", F.concat(F.lit("s"), F.substring("server", 2, 20)))


def uptimes(spark, sf):
    """Seconds up per server; one server has only just started."""
    status = view(spark, sf, "status").where("variable = 'Uptime'")
    value = F.col("value_raw").cast("bigint")
    short = F.col("server") == "s1"
    return status.groupBy("server").agg(
        F.max(F.when(~short, value).otherwise(-value)).alias("u")
    ).select("server", F.abs("u").alias("uptime_s"))


def fleet(*views: str) -> str:
    """The views and, as ``able``, which servers have what a reader needs."""
    return FLAGGED.replace(with_views("servers"), with_views("servers", *views), 1) + (
        ", able AS (SELECT concat('s', substr(server, 2)) AS server, CAST(substr(server, 2) AS BIGINT) % 4 <> 3 AS perf, flagged.* EXCLUDE (server) FROM flagged)"
    )


def gate(flag: str, columns: str, source: str) -> str:
    """Rows of able servers, and one row for each server that is not."""
    names = [c.split(" AS ")[-1].strip() for c in columns.split(",")]
    nothing = ", ".join(f"NULL AS {n}" for n in names)
    qualified = ", ".join(f"{source}.{c.strip()}" for c in columns.split(","))
    return (
        f" SELECT {source}.server AS server, {qualified}, true AS supported FROM {source} JOIN able ON able.server = {source}.server WHERE {flag} AND perf"
        f" UNION ALL SELECT server, {nothing}, false FROM able WHERE NOT ({flag} AND perf)"
    )


_SYSTEM = "('mysql', 'performance_schema', 'information_schema', 'sys')"
_DEFS = f""", defs AS (SELECT server, schema, table_, index_, list(column_ ORDER BY seq) AS cols, min(non_unique) = 0 AS uniq
      FROM v_index_columns WHERE schema NOT IN {_SYSTEM} GROUP BY server, schema, table_, index_)"""
# Servers s0, s1, s2, … run the version their number picks: only some hide indexes.
_CAPS = """, caps AS (SELECT concat('s', substr(server, 2)) AS server,
      version IN ('8.4.3', '8.0.22') AS invisible FROM v_servers)"""


def _action(schema: str = "schema", table: str = "table_", index: str = "index_") -> str:
    alter = f"'ALTER TABLE `' || {schema} || '`.`' || {table} || '` '"
    drop = f"{alter} || 'DROP INDEX `' || {index} || '`;'"
    return (
        f"CASE WHEN coalesce(invisible, false) THEN {alter} || 'ALTER INDEX `' || {index} || '` INVISIBLE;' || chr(10) || "
        f"'-- watch for regressions, then:' || chr(10) || {drop} ELSE {drop} END"
    )


@query(
    "index_definitions",
    with_views("index_columns")
    + _DEFS
    + """ SELECT server, schema, table_ AS "table", index_ AS "index", array_to_string(cols, ',') AS columns, uniq AS "unique" FROM defs""",
)
def _(spark, sf):
    return definitions(spark, sf).withColumn("columns", F.array_join("columns", ","))


_NO_PK = f""", nopk AS (SELECT t.server, t.schema, t.table_, coalesce(t.table_rows, 0) AS table_rows, coalesce(t.engine, '') AS engine
      FROM v_tables t LEFT JOIN v_constraints c ON c.server = t.server AND c.schema = t.schema AND c.table_ = t.table_
        AND c.constraint_type = 'PRIMARY KEY'
      WHERE t.table_type = 'BASE TABLE' AND c.server IS NULL AND t.schema NOT IN {_SYSTEM})"""


def no_pk(spark, sf):
    return I.tables_without_pk(view(spark, sf, "tables"), view(spark, sf, "constraints"))


@query("tables_without_pk", with_views("tables", "constraints") + _NO_PK + ' SELECT server, schema, table_ AS "table", table_rows, engine FROM nopk')
def _(spark, sf):
    return no_pk(spark, sf)


_SCANS = f""", scans AS (SELECT u.server, u.schema, u.table_, u.reads, coalesce(t.table_rows, 0) AS table_rows
      FROM (SELECT * FROM v_index_usage WHERE index_ IS NULL AND reads > 0 AND schema NOT IN {_SYSTEM}) u
      LEFT JOIN v_tables t ON t.server = u.server AND t.schema = u.schema AND t.table_ = u.table_)"""


def usage(spark, sf):
    """Two snapshots of the cumulative counters; only the newer one may count."""
    rows = view(spark, sf, "index_usage")
    older = rows.withColumns({"reads": F.col("reads") + 3, "writes": F.col("writes") + 1, "snapshot_ts": F.timestamp_seconds(F.lit(1_700_000_000))})
    return rows.withColumn("snapshot_ts", F.timestamp_seconds(F.lit(1_700_000_900))).unionByName(older)


def scans(spark, sf):
    return I.full_table_scans(usage(spark, sf), view(spark, sf, "tables"))


@query(
    "full_table_scans",
    fleet("index_usage", "tables") + _SCANS + gate("index_usage", 'schema, table_ AS "table", reads AS rows_full_scanned, table_rows', "scans"),
)
def _(spark, sf):
    return I.full_table_scans(usage(spark, sf), view(spark, sf, "tables"), capabilities=capabilities(spark, sf))


@query(
    "read_index_usage",
    fleet("index_usage")
    + f", u AS (SELECT * FROM v_index_usage WHERE index_ IS NOT NULL AND schema NOT IN {_SYSTEM})"
    + gate("index_usage", 'schema, table_ AS "table", index_ AS "index", reads, writes', "u"),
)
def _(spark, sf):
    return read_index_usage(usage(spark, sf), capabilities(spark, sf)).drop("snapshot_ts")


@query(
    "read_metadata_locks",
    fleet("metadata_locks")
    + """, m AS (SELECT server, object_type, coalesce(schema, '') AS schema, coalesce(name, '') AS name, lock_type,
      lock_status, coalesce(thread_id, 0) AS thread_id
    FROM v_metadata_locks WHERE schema IS NULL OR schema NOT IN ('performance_schema'))"""
    + gate("metadata_locks", "object_type, schema, name, lock_type, lock_status, thread_id", "m"),
)
def _(spark, sf):
    return read_metadata_locks(view(spark, sf, "metadata_locks"), capabilities(spark, sf)).drop("snapshot_ts")


# --------------------------------------------------------------- findings

_PAIRS = """, red AS (SELECT a.server, a.schema, a.table_, a.index_, a.cols, b.index_ AS bi, b.cols AS bc, len(a.cols) = len(b.cols) AS dup
      FROM defs a JOIN defs b ON a.server = b.server AND a.schema = b.schema AND a.table_ = b.table_ AND a.index_ <> b.index_
      WHERE upper(a.index_) <> 'PRIMARY' AND len(a.cols) <= len(b.cols)
        AND NOT (len(a.cols) = len(b.cols) AND a.index_ > b.index_)
        AND b.cols[1:len(a.cols)] = a.cols AND NOT (a.uniq AND NOT b.uniq)
      QUALIFY row_number() OVER (PARTITION BY a.server, a.schema, a.table_, a.index_ ORDER BY b.index_) = 1)"""
_RED = (
    """SELECT red.server AS server, CASE WHEN dup THEN 'high' ELSE 'warn' END AS severity,
      CASE WHEN dup THEN 'duplicate index' ELSE 'redundant index' END AS kind,
      schema || '.' || table_ || '.' || index_ AS object,
      '(' || array_to_string(cols, ', ') || ') is the start of `' || bi || '` (' || array_to_string(bc, ', ') || ')' AS detail, """
    + _action()
    + " AS action FROM red LEFT JOIN caps ON caps.server = red.server"
)


def redundant(spark, sf):
    return V.redundant_indexes(definitions(spark, sf), capabilities(spark, sf))


@query("redundant_indexes", with_views("index_columns", "servers") + _DEFS + _CAPS + _PAIRS + " " + _RED)
def _(spark, sf):
    return redundant(spark, sf)


_UPTIME = """, up AS (SELECT server, CASE WHEN server = 's1' THEN min(CAST(value_raw AS BIGINT)) ELSE max(CAST(value_raw AS BIGINT)) END AS s
      FROM v_status WHERE variable = 'Uptime' GROUP BY server)"""
_UNUSED = (
    f"""SELECT u.server AS server, 'warn' AS severity, 'unused index' AS kind,
      u.schema || '.' || u.table_ || '.' || u.index_ AS object,
      '0 reads, ' || CAST(u.writes AS VARCHAR) || ' writes in ' || CAST(s // 86400 AS VARCHAR) || 'd ' ||
        CAST(s % 86400 // 3600 AS VARCHAR) || 'h of uptime' AS detail,
      CASE WHEN d.server IS NOT NULL THEN {_action('u.schema', 'u.table_', 'u.index_')} END AS action
    FROM v_index_usage u JOIN up ON up.server = u.server
    LEFT JOIN defs d ON d.server = u.server AND d.schema = u.schema AND d.table_ = u.table_ AND d.index_ = u.index_
    LEFT JOIN caps ON caps.server = u.server
    WHERE u.index_ IS NOT NULL AND u.schema NOT IN {_SYSTEM} AND u.reads = 0 AND upper(u.index_) <> 'PRIMARY'
      AND s >= 604800 AND NOT coalesce(d.uniq, false)"""
)


def unused(spark, sf):
    return V.unused_indexes(read_index_usage(usage(spark, sf)), definitions(spark, sf), uptimes(spark, sf), capabilities(spark, sf))


@query("unused_indexes", with_views("index_usage", "index_columns", "servers", "status") + _DEFS + _CAPS + _UPTIME + " " + _UNUSED)
def _(spark, sf):
    return unused(spark, sf)


_SCANF = """SELECT server, CASE WHEN table_rows > 10000 THEN 'high' ELSE 'info' END AS severity, 'full table scan' AS kind,
      schema || '.' || table_ AS object,
      CAST(reads AS VARCHAR) || ' reads without an index of ~' || CAST(table_rows AS VARCHAR) || ' rows' AS detail,
      CAST(NULL AS VARCHAR) AS action FROM scans"""


@query("scan_findings", with_views("index_usage", "tables") + _SCANS + " " + _SCANF)
def _(spark, sf):
    return V.scan_findings(scans(spark, sf))


_NOPKF = """SELECT server, CASE WHEN table_rows > 100000 THEN 'high' ELSE 'warn' END AS severity, 'no primary key' AS kind,
      schema || '.' || table_ AS object,
      engine || ' table of ~' || CAST(table_rows AS VARCHAR) || ' rows without a primary key' AS detail,
      CAST(NULL AS VARCHAR) AS action FROM nopk"""


@query("missing_pk_findings", with_views("tables", "constraints") + _NO_PK + " " + _NOPKF)
def _(spark, sf):
    return V.missing_pk_findings(no_pk(spark, sf))


def _flat(n: int) -> str:
    return f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '…' ELSE text END"


_STMT = f""", dg AS (SELECT *, CASE WHEN rows_sent > 0 THEN rows_examined::DOUBLE / rows_sent ELSE rows_examined::DOUBLE END AS ratio,
      CASE WHEN schema = '' THEN '' ELSE schema || ' · ' END || 'digest ' || substr(digest, 1, 12) AS object
      FROM v_digests WHERE "count" >= 10),
    stmt AS (SELECT server, 'high' AS severity, 'statement without index' AS kind, object, CAST(no_index_used AS VARCHAR) || ' of ' ||
        CAST("count" AS VARCHAR) || ' executions without an index — ' || {_flat(120)} AS detail FROM dg WHERE no_index_used > 0
      UNION ALL SELECT server, 'warn', 'low selectivity', object, printf('%.0f', ratio) || ' rows examined per row sent — ' || {_flat(120)}
        FROM dg WHERE ratio > 100 AND rows_examined > 0
      UNION ALL SELECT server, 'warn', 'temp table on disk', object, CAST(tmp_disk_tables AS VARCHAR) || ' temporary tables on disk — ' ||
        {_flat(100)} FROM dg WHERE tmp_disk_tables > 0)"""
_STMTF = "SELECT *, CAST(NULL AS VARCHAR) AS action FROM stmt"


def digests(spark, sf):
    return view(spark, sf, "digests")


@query("statement_findings", with_views("digests") + _STMT + " " + _STMTF)
def _(spark, sf):
    return V.statement_findings(digests(spark, sf))


# Expected shapes of the statement templates, stated as facts.
def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


def _str(x) -> str:
    return "NULL" if x is None else f"'{x}'"


def _candidate(shape) -> list[str]:
    _schema, _table, eq, rng, order, _wrapped = shape
    cols: list[str] = []
    for c in [*eq, *([rng] if rng else order)]:
        if c.lower() not in [x.lower() for x in cols]:
            cols.append(c)
    return cols


_SHAPES = ", shp(k, sch, tbl, eq, rng, ord, wrapped, cand) AS (VALUES " + ", ".join(
    f"({k}, {_str(s[0])}, '{s[1]}', {_list(s[2])}, {_str(s[3])}, {_list(s[4])}, {_list(s[5])}, {_list(_candidate(s))})"
    for k, (_sql, s) in enumerate(TEMPLATES)
    if s is not None
) + ")"
_SHAPED = (
    with_views("digests")
    + _SHAPES
    + f""", sd AS (SELECT d.*, shp.* FROM v_digests d LEFT JOIN shp
      ON digest_text IS NOT NULL AND k = CAST(substr(digest, 8) AS BIGINT) % {len(TEMPLATES)})"""
)


@query(
    "statement_shapes",
    _SHAPED
    + """ SELECT server, digest, tbl IS NOT NULL AS judged, sch AS schema, tbl AS "table", array_to_string(eq, ',') AS equality, rng AS range,
      array_to_string(ord, ',') AS order_by, array_to_string(wrapped, ',') AS wrapped FROM sd""",
)
def _(spark, sf):
    return G.statement_shapes(digests(spark, sf)).select(
        "server", "digest", F.col("shape").isNotNull().alias("judged"), "shape.schema", "shape.table",
        F.array_join("shape.equality", ",").alias("equality"), "shape.range",
        F.array_join("shape.order_by", ",").alias("order_by"),
        F.array_join("shape.wrapped_columns", ",").alias("wrapped"),
    )


_FUNC = """SELECT server, 'warn' AS severity, 'function on column' AS kind, tbl || '.' || c AS object,
      'a function around `' || c || '` rules out its index — ' || {t} AS detail, CAST(NULL AS VARCHAR) AS action
    FROM sd, unnest(wrapped) AS x(c) WHERE "count" >= 10""".format(t=_flat(110))


@query("function_on_column", _SHAPED + " " + _FUNC)
def _(spark, sf):
    return V.function_on_column(digests(spark, sf))


@query(
    "drop_index_action",
    with_views("index_columns", "servers") + _DEFS + _CAPS
    + f' SELECT defs.server AS server, schema, table_ AS "table", index_ AS "index", {_action()} AS action FROM defs LEFT JOIN caps ON caps.server = defs.server',
)
def _(spark, sf):
    rows = definitions(spark, sf).join(capabilities(spark, sf).select("server", "invisible_index"), "server", "left")
    action = V.drop_index_action(F.col("invisible_index"), F.col("schema"), F.col("table"), F.col("index"))
    return rows.select("server", "schema", "table", "index", action.alias("action"))


_ADVICE = (
    with_views("index_columns", "index_usage", "tables", "constraints", "servers", "status") + ", " + _SHAPED[5:]
    + _DEFS + _CAPS + _PAIRS + _UPTIME + _SCANS + _NO_PK + _STMT
    + f""", advice AS ({_RED} UNION ALL {_UNUSED} UNION ALL {_SCANF} UNION ALL {_NOPKF} UNION ALL
      SELECT server, severity, kind, object, detail, CAST(NULL AS VARCHAR) FROM stmt UNION ALL {_FUNC})"""
)


def advice(spark, sf):
    rows = digests(spark, sf)
    return V.advise(
        redundant(spark, sf),
        unused(spark, sf),
        V.scan_findings(scans(spark, sf)),
        V.missing_pk_findings(no_pk(spark, sf)),
        V.statement_findings(rows),
        V.function_on_column(rows),
    )


@query("advise", _ADVICE + " SELECT * FROM advice")
def _(spark, sf):
    return advice(spark, sf)


@query("finding_kinds", _ADVICE + " SELECT DISTINCT kind FROM advice")
def _(spark, sf):
    return V.finding_kinds(advice(spark, sf))


@query("count_by_severity", _ADVICE + " SELECT server, severity, count(*) AS findings FROM advice GROUP BY server, severity")
def _(spark, sf):
    return V.count_by_severity(advice(spark, sf))


@query("filter_findings", _ADVICE + " SELECT * FROM advice WHERE kind = 'unused index'")
def _(spark, sf):
    return V.filter_findings(advice(spark, sf), "unused index")


# ------------------------------------------------------------ suggestions


@query("candidate_index", _SHAPED + " SELECT server, digest, array_to_string(cand, ',') AS candidate FROM sd")
def _(spark, sf):
    return G.statement_shapes(digests(spark, sf)).select(
        "server", "digest", F.array_join("candidate", ",").alias("candidate")
    )


_IMPACT = """, im AS (SELECT *, CASE WHEN (no_index_used > 0 AND "count" >= 100) OR ratio >= 1000 OR total_ms >= 60000 THEN 2
        WHEN no_index_used > 0 OR ratio >= 100 OR "count" >= 100 OR total_ms >= 5000 THEN 1 ELSE 0 END AS imp
      FROM (SELECT *, CASE WHEN rows_sent > 0 THEN rows_examined::DOUBLE / rows_sent ELSE rows_examined::DOUBLE END AS ratio FROM sd) z)"""
_LABEL = "CASE {c} WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END"


@query("estimate_impact", _SHAPED + _IMPACT + f" SELECT server, digest, {_LABEL.format(c='imp')} AS impact FROM im")
def _(spark, sf):
    return G.estimate_impact(digests(spark, sf)).select("server", "digest", "impact")


_MERGED = (
    with_views("workload_indexes") + ", " + _SHAPED[5:] + _IMPACT
    + """, asked AS (SELECT server, coalesce(sch, nullif(schema, '')) AS schema, tbl, cand, lower(array_to_string(cand, ',')) AS key, digest, digest_text,
        "count" AS n, total_ms, imp FROM im WHERE "count" >= 10 AND tbl IS NOT NULL AND len(cand) > 0 AND coalesce(sch, nullif(schema, '')) IS NOT NULL),
    merged AS (SELECT server, schema, tbl, key, arg_min(cand, (-total_ms, digest)) AS cols, max(imp) AS imp, CAST(sum(n) AS BIGINT) AS executions,
        sum(total_ms) AS total_ms, array_to_string(list(digest_text ORDER BY total_ms DESC, digest)[1:3], ' ; ') AS queries
      FROM asked GROUP BY server, schema, tbl, key),
    wi AS (SELECT server, schema, table_, index_, array_to_string(list(lower(column_) ORDER BY seq), ',') AS ik FROM v_workload_indexes GROUP BY ALL),
    own AS (SELECT m.server, m.schema, m.tbl, m.key, w.index_, w.ik FROM merged m JOIN wi w
      ON w.server = m.server AND lower(w.schema) = lower(m.schema) AND lower(w.table_) = lower(m.tbl)),
    kept AS (SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.server = m.server AND o.schema = m.schema AND o.tbl = m.tbl
      AND o.key = m.key AND starts_with(o.ik || ',', m.key || ','))),
    ext AS (SELECT server, schema, tbl, key, min(index_) AS extends FROM own WHERE ik <> key AND starts_with(key || ',', ik || ',') GROUP BY ALL)"""
)


def merged(spark, sf):
    return G.merge_proposals(G.proposals(digests(spark, sf)))


def workload_definitions(spark, sf):
    return I.index_definitions(view(spark, sf, "workload_indexes"))


@query("merge_proposals", _MERGED + ' SELECT server, schema, tbl AS "table", key, imp AS impact, executions, total_ms, queries FROM merged')
def _(spark, sf):
    return merged(spark, sf).select(
        "server", "schema", "table", F.array_join("key", ",").alias("key"), "impact", "executions", "total_ms",
        F.array_join("queries", " ; ").alias("queries"),
    )


@query("drop_covered", _MERGED + ' SELECT server, schema, tbl AS "table", key FROM kept')
def _(spark, sf):
    return G.drop_covered(merged(spark, sf), workload_definitions(spark, sf)).select(
        "server", "schema", "table", F.array_join("key", ",").alias("key")
    )


@query("extends_index", _MERGED + ' SELECT server, schema, tbl AS "table", key, extends FROM merged LEFT JOIN ext USING (server, schema, tbl, key)')
def _(spark, sf):
    return G.extends_index(merged(spark, sf), workload_definitions(spark, sf)).select(
        "server", "schema", "table", F.array_join("key", ",").alias("key"), "extends"
    )


_NAME = "substr(regexp_replace('idx_' || tbl || '_' || array_to_string(cols, '_'), '[^A-Za-z0-9_]', '', 'g'), 1, 64)"
_QUOTED = "array_to_string(list_transform(cols, lambda c: '`' || replace(c, '`', '``') || '`'), ', ')"
_DDL = (
    "CASE WHEN extends IS NULL THEN '' ELSE '-- extends the existing index `' || extends || '`' || chr(10) END || "
    "'ALTER TABLE `' || schema || '`.`' || tbl || '`' || chr(10) || "
    "CASE WHEN extends IS NULL THEN '' ELSE '  DROP INDEX `' || extends || '`,' || chr(10) END || "
    f"'  ADD INDEX `' || {_NAME} || '` (' || {_QUOTED} || '),' || chr(10) || '  ALGORITHM=INPLACE, LOCK=NONE;'"
)


def suggestions(spark, sf):
    return G.suggest_indexes(digests(spark, sf), workload_definitions(spark, sf))


@query(
    "suggest_indexes",
    _MERGED
    + f""" SELECT server, schema, tbl AS "table", array_to_string(cols, ',') AS columns, {_LABEL.format(c='imp')} AS impact, queries, executions, total_ms,
      extends FROM kept LEFT JOIN ext USING (server, schema, tbl, key)""",
)
def _(spark, sf):
    out = suggestions(spark, sf).withColumns(
        {"columns": F.array_join("columns", ","), "queries": F.array_join("queries", " ; ")}
    )
    return out.drop("index_name", "ddl", "columns_display")


@query("index_name", _MERGED + f' SELECT server, schema, tbl AS "table", {_NAME} AS index_name FROM kept')
def _(spark, sf):
    return suggestions(spark, sf).select("server", "schema", "table", "index_name")


@query("index_ddl", _MERGED + f' SELECT server, schema, tbl AS "table", {_DDL} AS ddl FROM kept LEFT JOIN ext USING (server, schema, tbl, key)')
def _(spark, sf):
    return suggestions(spark, sf).select("server", "schema", "table", "ddl")


@query("columns_display", _MERGED + " SELECT server, schema, tbl AS \"table\", 'INDEX(' || array_to_string(cols, ', ') || ')' AS columns_display FROM kept")
def _(spark, sf):
    return suggestions(spark, sf).select("server", "schema", "table", "columns_display")
