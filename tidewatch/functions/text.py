"""Display text, escaping and statement labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.numbers import fixed

# Leading keyword of a statement, by what it does.
READ_WORDS = ["select", "show", "explain", "describe", "desc", "with", "analyze", "table", "values"]
WRITE_WORDS = [
    "insert", "update", "delete", "replace", "load", "call", "do", "set", "begin",
    "start", "commit", "rollback", "flush", "kill", "grant", "revoke",
]
DDL_WORDS = ["create", "alter", "drop", "truncate", "rename"]

# Comments, then opening parentheses, then the first word.
LEADING_WORD = (
    r"^(?:\s*(?:--[^\n]*(?:\n|$)|#[^\n]*(?:\n|$)|/\*(?s:.*?)(?:\*/|$)))*\s*\(*\s*([A-Za-z]*)"
)


def one_line(c: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(
        F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))
    ).otherwise(flat)


def fmt_bytes(c: Column) -> Column:
    v = c.cast("double")
    out = None
    for power, unit in enumerate(["B", "KiB", "MiB", "GiB"]):
        text = F.concat(fixed(v / float(1024**power), 1), F.lit(f" {unit}"))
        below = v < float(1024 ** (power + 1))
        out = F.when(below, text) if out is None else out.when(below, text)
    return out.otherwise(F.concat(fixed(v / float(1024**4), 1), F.lit(" TiB")))


def fmt_count(c: Column) -> Column:
    return (
        F.when(c >= 1_000_000_000, F.concat(fixed(c / 1e9, 1), F.lit("B")))
        .when(c >= 1_000_000, F.concat(fixed(c / 1e6, 1), F.lit("M")))
        .when(c >= 1_000, F.concat(fixed(c / 1e3, 1), F.lit("k")))
        .otherwise(c.cast("string"))
    )


def fmt_ms(c: Column) -> Column:
    return (
        F.when(c >= 60_000.0, F.concat(fixed(c / 60_000.0, 1), F.lit(" min")))
        .when(c >= 1000.0, F.concat(fixed(c / 1000.0, 2), F.lit(" s")))
        .when(c >= 1.0, F.concat(fixed(c, 1), F.lit(" ms")))
        .otherwise(F.concat(fixed(c * 1000.0, 0), F.lit(" µs")))
    )


def fmt_duration(secs: Column) -> Column:
    """The two largest units of a number of whole seconds."""
    s = secs.cast("bigint")

    def part(unit: int, wrap: int | None = None) -> Column:
        n = F.floor(s / unit)
        return (n % wrap if wrap else n).cast("string")

    return (
        F.when(s >= 86400, F.concat(part(86400), F.lit("d "), part(3600, 24), F.lit("h")))
        .when(s >= 3600, F.concat(part(3600), F.lit("h "), part(60, 60), F.lit("m")))
        .when(s >= 60, F.concat(part(60), F.lit("m")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def format_datetime(millis: Column, zone: str = "UTC") -> Column:
    """Clock text in ``zone``, whatever zone the session runs in."""
    instant = F.timestamp_millis(millis)
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


def short_digest(c: Column) -> Column:
    return F.substring(c, 1, 12)


def is_safe_ident(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_$]{1,64}\z")


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_sql(c: Column) -> Column:
    """Body of a quoted SQL string; the backslash goes first."""
    return _replace_all(
        c,
        [("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("\x1a", "\\Z")],
    )


def escape_html(c: Column) -> Column:
    return _replace_all(
        c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    )


def escape_markdown(c: Column) -> Column:
    return _replace_all(
        c,
        [("\\", "\\\\"), ("|", "\\|"), ("\r\n", "<br>"), ("\r", "<br>"), ("\n", "<br>")],
    )


def statement_kind(sql: Column) -> Column:
    """``read``, ``write``, ``ddl`` or ``unknown`` by the first keyword."""
    word = F.lower(F.regexp_extract(sql, LEADING_WORD, 1))
    return (
        F.when(word.isin(READ_WORDS), F.lit("read"))
        .when(word.isin(WRITE_WORDS), F.lit("write"))
        .when(word.isin(DDL_WORDS), F.lit("ddl"))
        .otherwise(F.lit("unknown"))
    )


def matches_needle(needle: str, *cols: Column) -> Column:
    """Case-insensitive substring test over the columns joined by spaces."""
    hay = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])
    return F.contains(F.lower(hay), F.lower(F.lit(needle)))


def lock_summary(record: Column, table: Column, index: Column, mode: Column) -> Column:
    def tail(c: Column, text: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", text).otherwise(F.lit(""))

    return F.concat(
        F.when(record, F.lit("record lock")).otherwise(F.lit("table lock")),
        tail(table, F.concat(F.lit(" on "), table)),
        tail(index, F.concat(F.lit(" ("), index, F.lit(")"))),
        tail(mode, F.concat(F.lit(" mode "), mode)),
    )
