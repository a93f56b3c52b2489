"""Column functions: everything here is a JVM-side expression."""

from tidewatch.functions.binding import let, pinned
from tidewatch.functions.numbers import (
    fixed,
    is_number,
    number_text,
    parse_double,
    parse_i64,
    parse_u64,
    saturating_sub,
)
from tidewatch.functions.sessions import host_key, is_sleeping, usage_level, usage_pct, user_key
from tidewatch.functions.text import (
    escape_html,
    escape_markdown,
    escape_sql,
    fmt_bytes,
    fmt_count,
    fmt_duration,
    fmt_ms,
    format_datetime,
    is_safe_ident,
    lock_summary,
    matches_needle,
    one_line,
    short_digest,
    statement_kind,
)

__all__ = [
    "escape_html",
    "escape_markdown",
    "escape_sql",
    "fixed",
    "fmt_bytes",
    "fmt_count",
    "fmt_duration",
    "fmt_ms",
    "format_datetime",
    "host_key",
    "is_number",
    "is_safe_ident",
    "is_sleeping",
    "let",
    "lock_summary",
    "matches_needle",
    "number_text",
    "one_line",
    "parse_double",
    "parse_i64",
    "parse_u64",
    "pinned",
    "saturating_sub",
    "short_digest",
    "statement_kind",
    "usage_level",
    "usage_pct",
    "user_key",
]
