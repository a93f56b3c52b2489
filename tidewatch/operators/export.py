"""Result grids as CSV, JSON, Markdown, HTML and SQL text.

A renderer turns rows into lines next to the columns they sort by. Nothing
gathers a table in one place: ``write_lines`` sorts by range and writes one file
per partition, and the files in name order are the document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import escape_html, escape_markdown, escape_sql, is_number, number_text
from tidewatch.operators.positions import number_rows

# Fixed values.
NULL_MARK = "_NULL_"
BATCH_ROWS = 200
BATCH_BYTES = 512 * 1024
INSERT_ROWS = 50
VERBS = {"insert": "INSERT INTO", "ignore": "INSERT IGNORE INTO", "replace": "REPLACE INTO"}
BOM = "\ufeff"


def _ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """A cell as text; NULL stays NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(_ref(name))
    return _ref(name).cast("string")


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated column names get the first free suffix ``_2``, ``_3``, …"""
    taken: list[str] = []
    for name in names:
        out, n = name, 2
        if name in taken:
            out = f"{name}_{n}"
            while out in taken or out in names:
                n += 1
                out = f"{name}_{n}"
        taken.append(out)
    return taken


def quote_ident(name: str) -> str:
    if not name or len(name.encode()) > 64 or "\0" in name or "\n" in name:
        raise ValueError(f"bad identifier: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def quote_table(name: str) -> str:
    parts = name.strip().split(".")
    if len(parts) > 2:
        raise ValueError(f"bad table name: {name!r}")
    return ".".join(quote_ident(p) for p in parts)


def _shown(df: DataFrame, columns: Sequence[str] | None, keep: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keep] if columns is None else list(columns)


# ---------------------------------------------------------------- CSV


def csv_field(c: Column) -> Column:
    """RFC 4180 field: NULL is nothing, the empty string is ``""``."""
    quote = (c == "") | c.rlike(r'[,"\n\r]|^ | \z')
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(quote, quoted).otherwise(c), F.lit(""))


def csv_header(columns: Sequence[str]) -> str:
    def field(s: str) -> str:
        plain = s and s.strip(" ") == s and not any(x in s for x in ',"\n\r')
        return s if plain else '"' + s.replace('"', '""') + '"'

    return ",".join(field(c) for c in columns)


def to_csv(df: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns and ``line``, the row as CSV without its line end."""
    shown = _shown(df, columns, keep)
    cells: list[Column] = []
    for c in shown:
        cells += [F.lit(","), csv_field(as_text(df, c))] if cells else [csv_field(as_text(df, c))]
    return df.select(*keep, F.concat(*cells).alias("line"))


# ---------------------------------------------------------------- JSON


def to_ndjson(df: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One compact object of strings per row; NULL is ``null``.

    Without ``keep`` and ``columns`` repeated column names are suffixed.
    """
    if not keep and columns is None:
        df = df.toDF(*unique_names(df.columns))
    shown = _shown(df, columns, keep)
    record = F.struct(*[as_text(df, c).alias(c) for c in shown])
    return df.select(*keep, F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))


def to_json(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Lines of one JSON array: ``part`` 0 opens it, 1 holds rows, 2 closes it.

    Each row but the first has its comma in front, so rows are numbered: ``row_no`` is the last sort
    key, and rows that tie in ``order`` still give a valid array.
    """
    rows = to_ndjson(df, keep=order, columns=list(df.columns) if columns is None else columns)
    body = number_rows(rows, order).select(
        F.lit(1).alias("part"),
        *order,
        F.col("row_no").cast("bigint").alias("row_no"),
        F.when(F.col("row_no") == 0, F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"),
    )
    return _framed(body, [*order, "row_no"], "[", "]")


def _framed(body: DataFrame, order: Sequence[str], head: str, tail: str | None) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            *[T.StructField(c, body.schema[c].dataType) for c in order],
            T.StructField("line", T.StringType()),
        ]
    )
    blank = [None] * len(order)
    rows = [(0, *blank, head)] + ([(2, *blank, tail)] if tail is not None else [])
    return body.sparkSession.createDataFrame(rows, schema).unionByName(body)


# ------------------------------------------------------------ Markdown


def to_markdown(
    df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One padded table per group, as lines sorted by (group, part, order).

    Widths and alignment come from one aggregate per group; rows then meet that
    one row again. No group is ever gathered.
    """
    shown = _shown(df, columns, group)
    heads = {c: c.replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", "<br>")
             .replace("\r", "<br>").replace("\n", "<br>") for c in shown}
    cells = {f"c{i}": c for i, c in enumerate(shown)}
    text = {k: as_text(df, c) for k, c in cells.items()}
    trimmed = {k: F.regexp_replace(v, r"(?U)^\s+|\s+\z", "") for k, v in text.items()}
    rows = df.select(
        *group,
        *[F.col(o).alias(f"o_{o}") for o in order],
        *[F.coalesce(escape_markdown(v), F.lit(NULL_MARK)).alias(k) for k, v in text.items()],
        *[F.when(v.isNotNull(), is_number(trimmed[k])).alias(f"n_{k}") for k, v in text.items()],
    )
    sizes = rows.groupBy(*group).agg(
        *[
            F.greatest(F.max(F.length(k)), F.lit(max(3, len(heads[c])))).alias(f"w_{k}")
            for k, c in cells.items()
        ],
        *[F.coalesce(F.every(f"n_{k}"), F.lit(False)).alias(f"r_{k}") for k in cells],
    )

    def line(parts: Iterable[Column]) -> Column:
        return F.concat(F.lit("|"), *[x for p in parts for x in (F.lit(" "), p, F.lit(" |"))])

    def padded(value: Column, k: str) -> Column:
        w, right = F.col(f"w_{k}"), F.col(f"r_{k}")
        return F.when(right, F.lpad(value, w, F.lit(" "))).otherwise(F.rpad(value, w, F.lit(" ")))

    def rule(k: str) -> Column:
        w = F.col(f"w_{k}")
        dashes = F.when(
            F.col(f"r_{k}"), F.concat(F.repeat(F.lit("-"), w - 1), F.lit(":"))
        )
        return dashes.otherwise(F.repeat(F.lit("-"), w))

    blanks = [F.lit(None).cast(df.schema[o].dataType).alias(o) for o in order]
    head = sizes.select(
        *group, F.lit(0).alias("part"), *blanks,
        line(padded(F.lit(heads[c]), k) for k, c in cells.items()).alias("line"),
    )
    delimiter = sizes.select(
        *group, F.lit(1).alias("part"), *blanks, line(rule(k) for k in cells).alias("line")
    )
    # A group may be NULL, and keeps its rows.
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"s_{g}")) for g in group])
    body = rows.join(sizes.withColumnsRenamed({g: f"s_{g}" for g in group}), same).select(
        *group, F.lit(2).alias("part"), *[F.col(f"o_{o}").alias(o) for o in order],
        line(padded(F.col(k), k) for k in cells).alias("line"),
    )
    return head.unionByName(delimiter).unionByName(body)


# ---------------------------------------------------------------- HTML


def to_html(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    title: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One ``<table>`` per group, as lines sorted by (group, part, order)."""
    shown = _shown(df, columns, group)

    def cell(c: str) -> Column:
        value = F.concat(F.lit("<td>"), escape_html(as_text(df, c)), F.lit("</td>"))
        return F.coalesce(value, F.lit('<td class="null">NULL</td>'))

    body = df.select(
        *group,
        F.lit(1).alias("part"),
        *order,
        F.concat(F.lit("    <tr>"), *[cell(c) for c in shown], F.lit("</tr>")).alias("line"),
    )
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    plural = F.when(F.col("n") == 1, F.lit("")).otherwise(F.lit("s"))
    caption = escape_html(
        F.concat(F.lit(f"{title} — "), F.col("n").cast("string"), F.lit(" row"), plural)
    )
    names = F.concat(*[F.concat(F.lit("<th>"), escape_html(F.lit(c)), F.lit("</th>")) for c in shown])
    open_table = F.concat(
        F.lit("<table>\n  <caption>"), caption, F.lit("</caption>\n  <thead>\n    <tr>"), names,
        F.lit("</tr>\n  </thead>\n  <tbody>"),
    )
    blanks = [F.lit(None).cast(df.schema[o].dataType).alias(o) for o in order]
    head = counts.select(*group, F.lit(0).alias("part"), *blanks, open_table.alias("line"))
    tail = counts.select(
        *group, F.lit(2).alias("part"), *blanks, F.lit("  </tbody>\n</table>").alias("line")
    )
    return head.unionByName(body).unionByName(tail)


# ------------------------------------------------------------- INSERTs


def _tuple(values: Sequence[Column]) -> Column:
    inner: list[Column] = []
    for v in values:
        inner += [F.lit(","), v] if inner else [v]
    return F.concat(F.lit("("), *inner, F.lit(")"))


def _text_literal(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), escape_sql(c), F.lit("'")), F.lit("NULL"))


def insert_head(table: str, columns: Sequence[str], verb: str = "insert") -> str:
    """What a statement begins with, up to its first tuple."""
    return f"{VERBS[verb]} {quote_table(table)} ({', '.join(quote_ident(c) for c in columns)}) VALUES\n"


def _origin(df: DataFrame, name: str) -> str:
    """Column to insert into: where the cell came from, if that is known."""
    return df.schema[name].metadata.get("origin", name)


def to_inserts(
    df: DataFrame,
    table: str,
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    rows_per_statement: int = INSERT_ROWS,
    verb: str = "insert",
) -> DataFrame:
    """Statements of exactly ``rows_per_statement`` rows, the last one shorter.

    Each statement collects that many rows and no more.
    """
    shown = _shown(df, columns, ())
    head = insert_head(table, [_origin(df, c) for c in shown], verb)
    literals = df.select(
        *[F.col(o).alias(f"o_{o}") for o in order],
        _tuple([_text_literal(as_text(df, c)) for c in shown]).alias("values"),
    )
    numbered = number_rows(literals, [f"o_{o}" for o in order])
    per = max(rows_per_statement, 1)
    batch = F.floor(F.col("row_no") / per).cast("bigint")
    ordered = F.sort_array(F.collect_list(F.struct("row_no", "values")))
    return (
        numbered.groupBy(batch.alias("statement_no"))
        .agg(F.transform(ordered, lambda r: r["values"]).alias("rows"))
        .select(
            "statement_no",
            F.concat(F.lit(head), F.array_join("rows", ",\n"), F.lit(";")).alias("line"),
        )
    )


# ---------------------------------------------------------------- dump


def value_literal(df: DataFrame, name: str) -> Column:
    """A typed SQL literal: numbers bare, text escaped, other bytes as hex; NaN and infinities are NULL."""
    c, kind = _ref(name), df.schema[name].dataType
    if isinstance(kind, T.BinaryType):
        text = c.cast("string")
        literal = F.when(F.is_valid_utf8(text), _text_literal(text)).otherwise(
            F.concat(F.lit("0x"), F.hex(c))
        )
    elif isinstance(kind, T.BooleanType):
        literal = c.cast("int").cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # No server has a literal for these; a dump that could not be read back would be worth nothing.
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        literal = F.when(finite, as_text(df, name)).otherwise(F.lit("NULL"))
    elif isinstance(kind, T.NumericType):
        literal = as_text(df, name)
    else:
        literal = _text_literal(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), literal), F.lit("NULL"))


def _rough_size(df: DataFrame, name: str) -> Column:
    c, kind = _ref(name), df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        size = F.lit(12)
    else:
        size = F.octet_length(c if isinstance(kind, T.BinaryType) else c.cast("string")) + 3
    return F.when(c.isNull(), F.lit(4)).otherwise(size)


def dump_data(
    df: DataFrame,
    table: str,
    batch_rows: int = BATCH_ROWS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Multi-row INSERTs that end at ``batch_rows`` rows or ``batch_bytes``.

    Literals are built by Spark; the Python step only groups finished tuples.
    It reads them out of Arrow's batch statement by statement and gives each
    away as it ends, so besides that batch it holds one statement at a time.
    Every partition ends its own last statement, so partitions need not know
    of one another.
    """
    head = insert_head(table, df.columns)
    size = F.lit(0)
    for c in df.columns:
        size = size + _rough_size(df, c)
    tuples = df.select(
        _tuple([value_literal(df, c) for c in df.columns]).alias("values"), size.alias("size")
    )

    def joined(values: pa.Array) -> str:
        return ",\n".join(values.to_pylist())

    def statement(parts: list[str], rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"line": [head + ",\n".join(parts) + ";"], "rows": [rows]})

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []  # what earlier batches gave to the open statement
        rows = filled = 0
        for batch in batches:
            values, start = batch.column("values"), 0
            for end, n in enumerate(batch.column("size").to_pylist(), 1):
                rows, filled = rows + 1, filled + n
                if rows >= batch_rows or filled >= batch_bytes:
                    yield statement([*held, joined(values[start:end])], rows)
                    held, rows, filled, start = [], 0, 0, end
            if start < len(values):
                held.append(joined(values[start:]))
        if rows:
            yield statement(held, rows)

    return tuples.mapInArrow(group, "line string, rows bigint")


def dump_preamble(schema: str, server_version: str, created: str) -> str:
    return (
        f"-- `{schema}`, rows only, taken {created} from a server that says it is {server_version}\n"
        "SET NAMES utf8mb4;\nSET FOREIGN_KEY_CHECKS = 0;\nSET SQL_MODE = 'NO_AUTO_VALUE_ON_ZERO';\n"
    )


DUMP_EPILOGUE = "SET FOREIGN_KEY_CHECKS = 1;"
DUMP_STATS = "table string, rows bigint, statements bigint, bytes bigint"


def write_dump(statements: DataFrame, path: str) -> dict[str, int]:
    """Write the statements of one table; rows, statements and bytes as the write itself saw them."""
    seen = Observation()
    watched = statements.observe(
        seen,
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("statements"),
        # Each line ends with a line feed.
        F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes"),
    )
    watched.select("line").write.mode("overwrite").text(path)
    return seen.get


def dump_tables(
    tables: dict[str, DataFrame],
    path: str,
    schema: str,
    server_version: str,
    created: str,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Write the chosen tables under ``path``; sub-folders sort in restore order.

    Returns rows, statements and bytes of each table, counted while they were written. One small row per
    table comes to the driver.
    """
    if not tables:
        raise ValueError(f"no tables to dump in {schema}")
    chosen = sorted(tables) if only is None else list(only)
    spark = next(iter(tables.values())).sparkSession

    def text(value: str, folder: str) -> None:
        spark.createDataFrame([(value,)], "line string").write.mode("overwrite").text(f"{path}/{folder}")

    text(dump_preamble(schema, server_version, created), "0-preamble")
    found = []
    for name in chosen:
        seen = write_dump(dump_data(tables[name], name), f"{path}/1-{name}")
        found.append((name, seen["rows"], seen["statements"], seen["bytes"]))
    text(DUMP_EPILOGUE, "2-epilogue")
    return spark.createDataFrame(found, DUMP_STATS)


# --------------------------------------------------------------- files


def write_lines(lines: DataFrame, path: str, order: Sequence[str | Column], line_sep: str = "\n") -> None:
    """Text files whose name order is the order of the lines."""
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("line")
        .write.mode("overwrite")
        .option("lineSep", line_sep)
        .text(path)
    )


def write_csv(
    df: DataFrame, path: str, order: Sequence[str], bom: bool = False, columns: Sequence[str] | None = None
) -> None:
    shown = list(df.columns) if columns is None else list(columns)
    body = to_csv(df, keep=order, columns=shown).withColumn("part", F.lit(1))
    head = (BOM if bom else "") + csv_header(shown)
    write_lines(_framed(body, order, head, None), path, ["part", *order], "\r\n")
