"""Queries over the catalogue, row changes, exports and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import functions as T
from tidewatch.operators import catalog as K
from tidewatch.operators import changes as H
from tidewatch.operators import export as O
from tidewatch.plans.registry import query
from tidewatch.plans.views import base, view, with_views
from tidewatch.plans.workspace import folder_bytes, workspace

# ------------------------------------------------------------- catalogue


def tables(spark, sf):
    return view(spark, sf, "tables")


def described(spark, sf):
    return K.describe_table(view(spark, sf, "catalog_columns"))


@query("list_schemas", with_views("tables") + " SELECT DISTINCT server, schema FROM v_tables WHERE schema <> 'sys'")
def _(spark, sf):
    return K.list_schemas(tables(spark, sf))


_TABLES = """SELECT server, schema, table_ AS "table", coalesce(engine, '') AS engine, coalesce(table_rows, 0) AS table_rows,
      table_type = 'VIEW' AS is_view FROM v_tables"""


@query("list_tables", with_views("tables") + f" {_TABLES}")
def _(spark, sf):
    return K.list_tables(tables(spark, sf))


@query("filter_tables", with_views("tables") + f" {_TABLES} WHERE contains(lower(table_), 't1')")
def _(spark, sf):
    return K.filter_tables(K.list_tables(tables(spark, sf)), "T1")


@query(
    "describe_table",
    with_views("catalog_columns")
    + """ SELECT server, schema, table_ AS "table", ordinal, column_ AS "column", column_type, is_nullable = 'YES' AS nullable,
      column_key = 'PRI' AS is_pk, coalesce(extra, '') AS extra FROM v_catalog_columns""",
)
def _(spark, sf):
    return described(spark, sf)


_KEYS = """ SELECT server, schema, table_ AS "table",
      coalesce(array_to_string(list(column_ ORDER BY ordinal) FILTER (column_key = 'PRI'), ','), '') AS primary_key,
      count(*) FILTER (column_key = 'PRI') > 0 AS is_editable FROM v_catalog_columns GROUP BY server, schema, table_"""


@query("primary_key", with_views("catalog_columns") + _KEYS)
def _(spark, sf):
    return K.primary_key(described(spark, sf)).withColumn("primary_key", F.array_join("primary_key", ","))


@query("is_editable", with_views("catalog_columns") + f' SELECT server, "table", is_editable FROM ({_KEYS.strip()}) k')
def _(spark, sf):
    return K.primary_key(described(spark, sf)).select("server", "table", "is_editable")


_BROWSE = "o_orderstatus = 'F' AND o_totalprice > 200000"


@query(
    "browse_page",
    f"""WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS n,
        count(*) OVER () AS total FROM orders WHERE {_BROWSE})
    SELECT o_orderkey, o_orderpriority, total > 150 AS has_more FROM p WHERE n > 100 AND n <= 150""",
)
def _(spark, sf):
    rows = base(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    page = K.browse_page(
        rows, ["o_orderkey"], condition=_BROWSE, order_by="o_orderpriority", descending=True, limit=50, offset=100
    )
    return page.drop("o_orderstatus", "o_totalprice")


@query(
    "browse_after",
    f"""WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS n,
        count(*) OVER () AS total FROM orders WHERE {_BROWSE})
    SELECT o_orderkey, o_orderpriority, total > 150 AS has_more FROM p WHERE n > 100 AND n <= 150""",
)
def _(spark, sf):
    """The page behind the first hundred rows, found by the last key of those instead of by an offset."""
    rows = base(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    how = {"condition": _BROWSE, "order_by": "o_orderpriority", "descending": True}
    first = K.browse_page(rows, ["o_orderkey"], limit=100, **how)
    end = K.page_end(first, ["o_orderkey"], "o_orderpriority", descending=True)
    return K.browse_after(rows, end, ["o_orderkey"], limit=50, **how).drop("o_orderstatus", "o_totalprice")


@query(
    "equality_filter",
    with_views("grid") + " SELECT doc_id, 'null' AS kind FROM v_grid WHERE lang IS NULL UNION ALL SELECT doc_id, 'en' FROM v_grid WHERE lang = 'en'",
)
def _(spark, sf):
    rows = view(spark, sf, "grid")
    nulls = rows.where(K.equality_filter("lang", None)).select("doc_id", F.lit("null").alias("kind"))
    return nulls.unionByName(rows.where(K.equality_filter("lang", "en")).select("doc_id", F.lit("en").alias("kind")))


@query("count_rows", f"SELECT count(*) AS rows FROM orders WHERE {_BROWSE}")
def _(spark, sf):
    return K.count_rows(base(spark, sf, "orders"), _BROWSE)


_MIXED = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority
      WHEN 2 THEN {n} ELSE concat({n}, '.5') END AS cell FROM {t}"""


@query(
    "grid_sort",
    "WITH m AS (" + _MIXED.format(n="CAST(o_custkey AS VARCHAR)", t="orders") + """)
    SELECT o_orderkey, cell FROM m ORDER BY cell IS NOT NULL DESC, TRY_CAST(cell AS DOUBLE) IS NULL DESC,
      TRY_CAST(cell AS DOUBLE) DESC, CASE WHEN TRY_CAST(cell AS DOUBLE) IS NULL THEN cell END DESC, o_orderkey""",
)
def _(spark, sf):
    mixed = spark.sql(_MIXED.format(n="CAST(o_custkey AS STRING)", t="{orders}"), orders=base(spark, sf, "orders"))
    return K.grid_sort(mixed, "cell", ["o_orderkey"], descending=True)


@query(
    "row_key",
    """SELECT l_orderkey, 'l_orderkey=' || CAST(l_orderkey AS VARCHAR) || ';l_linenumber=' || CAST(l_linenumber AS VARCHAR) AS key,
      count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def _(spark, sf):
    rows = base(spark, sf, "lineitem").select("l_orderkey", K.row_key("l_orderkey", "l_linenumber").alias("k"))
    shown = F.array_join(F.transform("k", lambda p: F.concat(p["column"], F.lit("="), p["value"])), ";")
    return rows.groupBy("l_orderkey", shown.alias("key")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- changes

# Updates come from order lines; a third of them hit order 0. Every fourth order
# is deleted and inserted again line by line; some orders are new.
_LINES = """SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey * 8 + l_linenumber AS s,
      min(l_partkey) AS price, min(l_suppkey) AS prio FROM {t} GROUP BY l_orderkey, l_linenumber"""
_AGAIN = "k % 4 = 0 AND n >= 3"
_LOG = [
    ("update", "s * 2", "CASE WHEN s % 3 = 0 THEN 0 ELSE k END", f"NOT ({_AGAIN})"),
    ("delete", "s * 2", "k", _AGAIN),
    ("insert", "s * 2 + 1", "k", f"{_AGAIN} AND n < 7"),
    ("insert", "s * 2 + 1", "k + 100000000", "k % 10 = 1 AND n = 1"),
]


def orders(spark, sf):
    cents = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    return base(spark, sf, "orders").select("o_orderkey", cents.alias("cents"), "o_orderpriority")


def change_log(spark, sf):
    lines = spark.sql(_LINES.format(t="{lineitem}"), lineitem=base(spark, sf, "lineitem"))
    out = None
    for op, seq, key, where in _LOG:
        pair = lambda name, e: F.struct(F.lit(name).alias("column"), F.expr(e).alias("value"))
        key_pair = pair("o_orderkey", f"CAST({key} AS STRING)")
        cents = pair("cents", "CAST(price AS STRING)")
        prio = pair("o_orderpriority", "CASE WHEN prio % 5 = 0 THEN NULL ELSE CONCAT('p', CAST(prio AS STRING)) END")
        if op == "update":
            values = F.when(F.expr("n % 2 = 0"), F.array(cents)).otherwise(F.array(prio))
        elif op == "insert":
            values = F.array(key_pair, cents)
        else:
            values = F.array().cast(H.PAIRS)
        one = lines.where(where).select(
            F.expr(f"CAST({seq} AS BIGINT)").alias("seq"), F.lit(op).alias("op"),
            F.array(key_pair).alias("key"), values.alias("values"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_LOG_SQL = ", lines AS (" + _LINES.format(t="lineitem") + "), log AS (" + " UNION ALL ".join(
    f"""SELECT {seq} AS seq, '{op}' AS op, {key} AS k, {"n % 2 = 0" if op == "update" else str(op == "insert").lower()} AS set_cents,
      price, {"n % 2 <> 0" if op == "update" else "false"} AS set_prio,
      CASE WHEN prio % 5 = 0 THEN NULL ELSE concat('p', CAST(prio AS VARCHAR)) END AS prio FROM lines WHERE {where}"""
    for op, seq, key, where in _LOG
) + ")"
_BASE_SQL = "WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders)"


@query(
    "apply_changes",
    _BASE_SQL
    + _LOG_SQL
    + """, reset AS (SELECT k, max(seq) AS seq, arg_max(op, seq) AS op FROM log WHERE op <> 'update' GROUP BY k),
    live AS (SELECT l.* FROM log l LEFT JOIN reset r ON r.k = l.k WHERE l.op <> 'delete' AND (r.k IS NULL OR l.seq >= r.seq)),
    c AS (SELECT k, arg_max(price, seq) AS v FROM live WHERE set_cents GROUP BY k),
    p AS (SELECT k, arg_max({'v': prio}, seq).v AS v FROM live WHERE set_prio GROUP BY k),
    keys AS (SELECT o_orderkey AS k FROM b UNION SELECT k FROM reset WHERE op = 'insert')
    SELECT keys.k AS o_orderkey, CASE WHEN c.k IS NOT NULL THEN c.v WHEN r.k IS NULL THEN b.cents END AS cents,
      CASE WHEN p.k IS NOT NULL THEN p.v WHEN r.k IS NULL THEN b.o_orderpriority END AS o_orderpriority
    FROM keys LEFT JOIN b ON b.o_orderkey = keys.k LEFT JOIN reset r ON r.k = keys.k
      LEFT JOIN c ON c.k = keys.k LEFT JOIN p ON p.k = keys.k WHERE r.k IS NULL OR r.op = 'insert'""",
)
def _(spark, sf):
    return H.apply_changes(orders(spark, sf), change_log(spark, sf), ["o_orderkey"])


@query(
    "affected_rows",
    _BASE_SQL
    + _LOG_SQL
    + """, traced AS (SELECT log.*, last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER
        (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log)
    SELECT count(*) FILTER (op = 'insert' OR before = 'insert' OR (before IS NULL AND b.o_orderkey IS NOT NULL)) AS affected
    FROM traced LEFT JOIN b ON b.o_orderkey = k""",
)
def _(spark, sf):
    return H.affected_rows(orders(spark, sf), change_log(spark, sf), ["o_orderkey"])


@query(
    "change_preview",
    _BASE_SQL
    + _LOG_SQL
    + """ SELECT seq, CASE op WHEN 'delete' THEN 'DELETE FROM `shop`.`o``s` WHERE `o_orderkey` <=> ''' || CAST(k AS VARCHAR) || ''' LIMIT 1'
      WHEN 'insert' THEN 'INSERT INTO `shop`.`o``s` (`o_orderkey`, `cents`) VALUES (''' || CAST(k AS VARCHAR) || ''', ''' || CAST(price AS VARCHAR) || ''')'
      ELSE 'UPDATE `shop`.`o``s` SET ' || CASE WHEN set_cents THEN '`cents` = ''' || CAST(price AS VARCHAR) || ''''
        ELSE '`o_orderpriority` = ' || coalesce('''' || prio || '''', 'NULL') END || ' WHERE `o_orderkey` <=> ''' || CAST(k AS VARCHAR) || ''' LIMIT 1'
      END AS preview FROM log""",
)
def _(spark, sf):
    return change_log(spark, sf).select("seq", H.change_preview(F.lit("shop"), F.lit("o`s")).alias("preview"))


# --------------------------------------------------------------- exports


def grid(spark, sf):
    return view(spark, sf, "grid")


_CELLS = ["doc_id", "lang", "source", "n_chars", "text"]


def _csv(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return (
        f"""CASE WHEN {c} IS NULL THEN '' WHEN {v} = '' OR contains({v}, ',') OR contains({v}, '"') OR contains({v}, chr(10))
        OR contains({v}, chr(13)) OR starts_with({v}, ' ') OR ends_with({v}, ' ')
        THEN '"' || replace({v}, '"', '""') || '"' ELSE {v} END"""
    )


@query("to_csv", with_views("grid") + " SELECT doc_id, " + " || ',' || ".join(_csv(c) for c in _CELLS) + " AS line FROM v_grid")
def _(spark, sf):
    return O.to_csv(grid(spark, sf), keep=["doc_id"], columns=_CELLS)


_JSON = "to_json({" + ", ".join(f"'{c}': CAST({c} AS VARCHAR)" for c in _CELLS) + "})"


@query("to_ndjson", with_views("grid") + f" SELECT doc_id, CAST({_JSON} AS VARCHAR) AS line FROM v_grid")
def _(spark, sf):
    return O.to_ndjson(grid(spark, sf), keep=["doc_id"], columns=_CELLS)


@query(
    "to_json",
    with_views("grid")
    + f""" SELECT 1 AS part, doc_id, row_no, CASE WHEN row_no = 0 THEN '' ELSE ',' END || CAST({_JSON} AS VARCHAR) AS line
      FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM v_grid)
    UNION ALL SELECT 0, NULL, NULL, '[' UNION ALL SELECT 2, NULL, NULL, ']'""",
)
def _(spark, sf):
    return O.to_json(grid(spark, sf), order=["doc_id"], columns=_CELLS)


# Customers as one report per nation.
_CUST = """SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL
      ELSE concat('a|b\\\\', c_mktsegment, {nl}) END AS segment,
      CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(floor(c_acctbal * 100) AS BIGINT) END AS cents FROM {t}"""


def customers(spark, sf):
    return spark.sql(_CUST.format(nl="'x\\n'", t="{customer}"), customer=base(spark, sf, "customer"))


_CUST_SQL = "WITH cu AS (" + _CUST.replace("\\\\", "\\").format(nl="'x' || chr(10)", t="customer") + ")"
_MD = {
    "id": "CAST(id AS VARCHAR)",
    "segment": r"coalesce(replace(replace(replace(segment, '\', '\\'), '|', '\|'), chr(10), '<br>'), '_NULL_')",
    "cents": "coalesce(CAST(cents AS VARCHAR), '_NULL_')",
}


def _md_line(cells: dict[str, str]) -> str:
    parts = []
    for c, e in cells.items():
        pad = f"repeat(' ', w_{c} - length({e}))"
        parts.append(f"{e} || {pad}" if c == "segment" else f"{pad} || {e}")
    return "'| ' || " + " || ' | ' || ".join(parts) + " || ' |'"


@query(
    "to_markdown",
    _CUST_SQL
    + ", w AS (SELECT nation, "
    + ", ".join(f"greatest(max(length({e})), {max(3, len(c))}) AS w_{c}" for c, e in _MD.items())
    + f""" FROM cu GROUP BY nation)
    SELECT nation, 2 AS part, id, {_md_line(_MD)} AS line FROM cu JOIN w USING (nation)
    UNION ALL SELECT nation, 0, NULL, {_md_line({c: f"'{c}'" for c in _MD})} FROM w
    UNION ALL SELECT nation, 1, NULL, '| ' || repeat('-', w_id - 1) || ': | ' || repeat('-', w_segment) || ' | ' || repeat('-', w_cents - 1) || ': |' FROM w""",
)
def _(spark, sf):
    return O.to_markdown(customers(spark, sf), ["nation"], ["id"], ["id", "segment", "cents"])


def _html(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")]:
        v = f"replace({v}, '{a}', '{b}')"
    return f"coalesce('<td>' || {v} || '</td>', '<td class=\"null\">NULL</td>')"


@query(
    "to_html",
    with_views("grid")
    + f""" SELECT lang, 1 AS part, doc_id, '    <tr>' || {' || '.join(_html(c) for c in _CELLS)} || '</tr>' AS line FROM v_grid
    UNION ALL SELECT lang, 0, NULL, '<table>' || chr(10) || '  <caption>Docs &amp; more — ' || CAST(count(*) AS VARCHAR) || CASE count(*) WHEN 1 THEN ' row' ELSE ' rows' END
      || '</caption>' || chr(10) || '  <thead>' || chr(10) || '    <tr>{''.join(f"<th>{c}</th>" for c in _CELLS)}</tr>' || chr(10) || '  </thead>' || chr(10) || '  <tbody>'
      FROM v_grid GROUP BY lang
    UNION ALL SELECT lang, 2, NULL, '  </tbody>' || chr(10) || '</table>' FROM v_grid GROUP BY lang""",
)
def _(spark, sf):
    return O.to_html(grid(spark, sf), ["lang"], ["doc_id"], "Docs & more", _CELLS)


def _escaped(e: str) -> str:
    return f"replace(replace(replace(replace({e}, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r')"


def _quoted(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"coalesce('''' || {_escaped(v)} || '''', 'NULL')"


_TUPLE = "'(' || " + " || ',' || ".join(_quoted(c) for c in _CELLS) + " || ')'"


@query(
    "to_inserts",
    with_views("grid")
    + f""", t AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS statement_no, doc_id, {_TUPLE} AS v FROM v_grid)
    SELECT statement_no, 'INSERT IGNORE INTO `shop`.`docs` ({', '.join(f"`{c}`" for c in _CELLS)}) VALUES' || chr(10)
      || string_agg(v, ',' || chr(10) ORDER BY doc_id) || ';' AS line FROM t GROUP BY statement_no""",
)
def _(spark, sf):
    return O.to_inserts(grid(spark, sf), "shop.docs", ["doc_id"], _CELLS, verb="ignore")


_DUMP_TUPLE = (
    "'(' || CAST(doc_id AS VARCHAR) || ',' || " + _quoted("lang") + " || ',' || " + _quoted("source") + " || ',' || CAST(n_chars AS VARCHAR) || ',' || "
    + "CASE WHEN doc_id % 3 = 0 THEN '0xFF' || upper(hex(encode(text))) ELSE " + _quoted("text") + " END || ')'"
)


def dump_rows(spark, sf):
    """Documents with a binary column that is not always text."""
    blob = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(X'FF', CAST(text AS BINARY)) ELSE CAST(text AS BINARY) END")
    return grid(spark, sf).select("doc_id", "lang", "source", "n_chars", blob.alias("body"))


def dumped(spark, sf):
    return O.dump_data(dump_rows(spark, sf), "docs")


@query("dump_data", with_views("grid") + f" SELECT {_DUMP_TUPLE} AS values FROM v_grid")
def _(spark, sf):
    # Statements end where partitions do, so rows are compared, not statements.
    body = F.regexp_extract("line", r"(?s)^INSERT INTO `docs` \(`doc_id`, `lang`, `source`, `n_chars`, `body`\) VALUES\n(.*);\z", 1)
    return dumped(spark, sf).select(F.explode(F.split(body, r",\n")).alias("values"))


_PRICES = "SELECT o_orderkey, floor(o_totalprice)::DOUBLE / 8 AS eighth, o_orderkey % 2 = 0 AS even FROM orders"
_PRICE_TUPLE = "'(' || CAST(o_orderkey AS VARCHAR) || ',' || regexp_replace(CAST(eighth AS VARCHAR), '\\.0$', '') || ',' || CASE WHEN even THEN '1' ELSE '0' END || ')'"


@query(
    "dump_stats",
    with_views("grid")
    + f""" SELECT 'docs' AS "table", count(*) AS rows, CAST(sum(strlen({_DUMP_TUPLE})) AS BIGINT) AS tuple_bytes, true AS bytes_are_those_of_the_files FROM v_grid
    UNION ALL SELECT 'prices', count(*), CAST(sum(strlen({_PRICE_TUPLE})) AS BIGINT), true FROM ({_PRICES}) x""",
)
def _(spark, sf):
    """What a whole dump reports. How many statements it takes rests on the partitions, so their frame is taken off."""
    home = workspace(spark)
    cents = F.col("o_totalprice").cast("bigint").cast("double")
    prices = base(spark, sf, "orders").select("o_orderkey", (cents / 8).alias("eighth"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    tables = {"docs": dump_rows(spark, sf), "prices": prices}
    stats = O.dump_tables(tables, home, "shop", "9.1.0", "today")
    # A statement is its head, tuples with a comma and a line feed between them, a semicolon and a line feed.
    heads = {n: len(O.insert_head(n, df.columns)) + 2 for n, df in tables.items()}
    head = F.when(F.col("table") == "docs", heads["docs"]).otherwise(heads["prices"])
    frame = F.col("statements") * head + (F.col("rows") - F.col("statements")) * 2
    written = F.when(F.col("table") == "docs", folder_bytes(spark, f"{home}/1-docs")).otherwise(folder_bytes(spark, f"{home}/1-prices"))
    return stats.select(
        "table", "rows", (F.col("bytes") - frame).alias("tuple_bytes"), (F.col("bytes") == written).alias("bytes_are_those_of_the_files")
    )


# --------------------------------------------------------------- scalars


def documents(spark, sf):
    return base(spark, sf, "documents")


@query("one_line", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS line FROM f""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.one_line(F.col("text"), 120).alias("line"))


_BIG = "o_orderkey * o_orderkey * 37 * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END)"


def big_numbers(spark, sf):
    """Keys with ``_BIG`` in whole numbers of 38 digits: 64 bits end before key 499,280."""
    big = f"CAST(o_orderkey AS DECIMAL(20, 0)) * {_BIG.removeprefix('o_orderkey * ')}"
    return base(spark, sf, "orders").select("o_orderkey", F.expr(big).alias("big"))


@query(
    "fmt_bytes",
    f"""WITH v AS (SELECT o_orderkey, CAST({_BIG} AS DOUBLE) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024)
      WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824)
      ELSE printf('%.1f TiB', b / 1099511627776) END AS text FROM v""",
)
def _(spark, sf):
    return big_numbers(spark, sf).select("o_orderkey", T.fmt_bytes(F.col("big")).alias("text"))


@query(
    "fmt_count",
    f"""WITH v AS (SELECT o_orderkey, {_BIG} AS b FROM orders)
    SELECT o_orderkey, CASE WHEN b >= 1000000000 THEN printf('%.1fB', b / 1e9) WHEN b >= 1000000 THEN printf('%.1fM', b / 1e6)
      WHEN b >= 1000 THEN printf('%.1fk', b / 1e3) ELSE CAST(b AS VARCHAR) END AS text FROM v""",
)
def _(spark, sf):
    return big_numbers(spark, sf).select("o_orderkey", T.fmt_count(F.col("big")).alias("text"))


_MS = "CAST(o_orderkey AS DOUBLE) * 7 / 16 * (CASE o_orderkey % 3 WHEN 0 THEN 0.0078125 ELSE 3 END)"


@query(
    "fmt_ms",
    f"""WITH v AS (SELECT o_orderkey, {_MS} AS m FROM orders)
    SELECT o_orderkey, CASE WHEN m >= 60000 THEN printf('%.1f min', m / 60000) WHEN m >= 1000 THEN printf('%.2f s', m / 1000)
      WHEN m >= 1 THEN printf('%.1f ms', m) ELSE printf('%.0f µs', m * 1000) END AS text FROM v""",
)
def _(spark, sf):
    return base(spark, sf, "orders").select("o_orderkey", T.fmt_ms(F.expr(_MS)).alias("text"))


@query(
    "fmt_duration",
    """WITH v AS (SELECT o_orderkey, o_orderkey * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 97 END) AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || 'd ' || CAST(s % 86400 // 3600 AS VARCHAR) || 'h'
      WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm'
      WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm' ELSE CAST(s AS VARCHAR) || 's' END AS text FROM v""",
)
def _(spark, sf):
    secs = F.expr("o_orderkey * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 97 END)")
    return base(spark, sf, "orders").select("o_orderkey", T.fmt_duration(secs).alias("text"))


@query("short_digest", "SELECT doc_id, substr(md5(text), 1, 12) AS digest FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.short_digest(F.md5("text")).alias("digest"))


@query("escape_sql", f"SELECT doc_id, {_escaped('text')} AS text FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.escape_sql(F.col("text")).alias("text"))


@query(
    "escape_html",
    "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages",
)
def _(spark, sf):
    return base(spark, sf, "pages").select("page_id", T.escape_html(F.col("html")).alias("html"))


@query(
    "escape_markdown",
    r"""SELECT page_id, replace(replace(replace(replace(replace(html, '\', '\\'), '|', '\|'), chr(13) || chr(10), '<br>'), chr(13), '<br>'), chr(10), '<br>') AS html FROM pages""",
)
def _(spark, sf):
    return base(spark, sf, "pages").select("page_id", T.escape_markdown(F.col("html")).alias("html"))


@query(
    "is_safe_ident",
    """SELECT c_custkey, regexp_full_match(name, '[A-Za-z0-9_$]{1,64}') AS safe FROM
      (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN '' ELSE concat(c_mktsegment, '_$', CAST(c_custkey AS VARCHAR)) END AS name FROM customer) c""",
)
def _(spark, sf):
    name = F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN '' "
        "ELSE concat(c_mktsegment, '_$', CAST(c_custkey AS STRING)) END"
    )
    return base(spark, sf, "customer").select("c_custkey", T.is_safe_ident(name).alias("safe"))


@query(
    "format_datetime",
    with_views("metrics") + " SELECT seq, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S') AS text FROM v_metrics",
)
def _(spark, sf):
    return view(spark, sf, "metrics").select("seq", T.format_datetime(F.col("ts")).alias("text"))
