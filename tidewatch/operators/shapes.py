"""Statement shapes: what a normalised SELECT filters and sorts by.

A digest text has placeholders for literals, so its shape can be read with
regular expressions and array functions. The text becomes a line of tokens
separated by blanks, with every identifier in backticks. One walk over the tokens of the
WHERE clause then finds the predicates and the calls around columns: nothing inside a call is a
predicate, so all it has to know is how many parentheses the outermost call still has open. Rows that
cannot be judged (joins, OR, sub-selects, UNION) get a NULL shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.binding import let

# Reserved words that are not identifiers.
KEYWORDS = [
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "BETWEEN", "ORDER",
    "GROUP", "BY", "LIMIT", "HAVING", "JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "CROSS", "ON",
    "UNION", "AS", "ASC", "DESC", "UPDATE", "DELETE", "INSERT", "SET", "VALUES", "FOR", "OFFSET",
]

TOKEN = r"(?U)`(?:[^`]|``)*`?|[A-Za-z_][A-Za-z0-9_]*|<=>|>=|<=|<>|!=|\S"

# Characters that mean something on the token line are stored as private-use
# code points while they are part of a name.
_SPECIAL = " `().,"
_STORED = "".join(chr(0xE100 + i) for i in range(len(_SPECIAL)))

ID = "`[^`]*`"
COLUMN = rf"(?:{ID} \. )*`([^`]*)`"
RANGE_OPS = [">", "<", ">=", "<=", "BETWEEN", "LIKE"]
EQUAL_OPS = ["=", "<=>", "IN", "IS"]


def _stored(name: Column) -> Column:
    return F.translate(name, _SPECIAL, _STORED)


def _restored(name: Column) -> Column:
    return F.translate(name, _STORED, _SPECIAL)


def dedupe(names: Column) -> Column:
    """Drop repeats that differ only in case, keeping the first spelling."""
    lower = F.transform(names, F.lower)
    return F.filter(names, lambda n, i: F.array_position(lower, F.lower(n)) == i + 1)


def token_line(sql: Column) -> Column:
    def canonical(t: Column) -> Column:
        inner = F.replace(F.regexp_replace(t, "^`|`$", ""), F.lit("``"), F.lit("`"))
        quoted = F.concat(F.lit("`"), _stored(inner), F.lit("`"))
        bare = F.concat(F.lit("`"), t, F.lit("`"))
        return (
            F.when(t.startswith("`"), quoted)
            .when(F.upper(t).isin(KEYWORDS), F.upper(t))
            .when(t.rlike("^[A-Za-z_]"), bare)
            .otherwise(t)
        )

    tokens = F.transform(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), canonical)
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


_WALK = "struct<open:int,preds:array<struct<col:string,op:string>>,wrapped:array<string>>"
#: Tokens a step sees: two before it, itself, and enough behind it for a call's first ``a.b.c``.
_BEFORE, _AFTER = 2, 6


def _is_name(token: Column) -> Column:
    return F.startswith(token, F.lit("`"))


def _inner(token: Column) -> Column:
    return F.regexp_replace(token, "`", "")


def _first_argument(after: list[Column]) -> Column:
    """The column, or the call, that a call's arguments begin with; NULL for anything else."""
    one, dot, two, dot_two, three = after[:5]

    def dotted(d: Column, n: Column) -> Column:
        return (d == ".") & _is_name(n)

    last = F.when(dotted(dot, two) & dotted(dot_two, three), three).when(dotted(dot, two), two).otherwise(one)
    return F.when(_is_name(one), _inner(last))


def _walk(clause: Column) -> Column:
    """Predicates and wrapped columns of a clause, in one pass over its tokens."""
    edge = F.lit("")

    def around(tokens: Column) -> Column:
        pad = F.concat(F.array(*[edge] * _BEFORE), tokens, F.array(*[edge] * _AFTER))
        views = [F.slice(pad, F.lit(k + 1), F.size(tokens)).alias(f"t{k}") for k in range(_BEFORE + 1 + _AFTER)]
        return F.arrays_zip(*views)

    def step(state: Column, x: Column) -> Column:
        at = [x[f"t{k}"] for k in range(_BEFORE + 1 + _AFTER)]
        two_back, back, token, after = at[0], at[1], at[2], at[3:]
        outside = state["open"] == 0
        calls = outside & (token == "(") & _is_name(back) & (two_back != ".")
        compared = after[0].isin(*RANGE_OPS, *EQUAL_OPS) & ~((after[0] == "IS") & (after[1] == "NOT"))
        found = outside & _is_name(token) & compared
        argument = _first_argument(after)
        wraps = calls & argument.isNotNull()
        still = F.greatest(F.lit(0), state["open"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0))
        pair = F.struct(_inner(token).alias("col"), after[0].alias("op"))
        return F.struct(
            F.when(calls, 1).when(outside, 0).otherwise(still).alias("open"),
            F.when(found, F.concat(state["preds"], F.array(pair))).otherwise(state["preds"]).alias("preds"),
            F.when(wraps, F.concat(state["wrapped"], F.array(argument))).otherwise(state["wrapped"]).alias("wrapped"),
        ).cast(_WALK)

    start = F.struct(F.lit(0).alias("open"), F.array().alias("preds"), F.array().alias("wrapped")).cast(_WALK)
    return F.aggregate(let(F.split(F.trim(clause), " "), around), start, step)


def _names(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(group))


def _table(source: Column) -> Column:
    """Schema and table after FROM, or NULL when there is not exactly one."""
    one = rf"^`([^`]*)` (?!\. )"
    two = r"^`([^`]*)` \. `([^`]*)` "
    dotted = source.rlike(two)
    joined = rf"^{ID}(?: \. {ID})?(?: AS \S+| {ID})? , "
    name = F.when(dotted, F.regexp_extract(source, two, 2)).otherwise(F.regexp_extract(source, one, 1))
    return F.when(
        (dotted | source.rlike(one)) & ~source.rlike(joined),
        F.struct(
            F.when(dotted, _restored(F.regexp_extract(source, two, 1))).alias("schema"),
            _restored(name).alias("table"),
        ),
    )


def _is_range(predicate: Column) -> Column:
    return predicate["op"].isin(RANGE_OPS)


def _first_range(preds: Column) -> Column:
    """Only the first range column can use an index, and only if no equality
    written before it already pins the column."""

    def usable(p: Column, i: Column) -> Column:
        pinned_before = F.exists(
            F.slice(preds, F.lit(1), i),
            lambda q: ~_is_range(q) & (F.lower(q["col"]) == F.lower(p["col"])),
        )
        return _is_range(p) & ~pinned_before

    return F.get(F.filter(preds, usable), F.lit(0))["col"]


def _order_columns(line: Column) -> Column:
    """Sort columns up to the first thing that is not a plain column."""
    item = rf"(?:{ID}(?: \. {ID})*|ASC|DESC|,) "
    head = rf"(?s)^.*? ORDER (?:BY )?((?:{item})*)(.?)"

    def columns(parts: Column) -> Column:
        cols = _names(parts["items"], COLUMN, 1)
        cut = parts["next"].isin("(", ".")
        return F.when(cut, F.slice(cols, F.lit(1), F.greatest(F.size(cols) - 1, F.lit(0)))).otherwise(cols)

    found = F.struct(
        F.regexp_extract(line, head, 1).alias("items"), F.regexp_extract(line, head, 2).alias("next")
    )
    return let(found, columns)


def _restored_all(names: Column) -> Column:
    return F.transform(let(names, dedupe), _restored)


def statement_shape(sql: Column) -> Column:
    """Shape struct of a SELECT over one table, or NULL."""
    where = r"(?s)^.*? WHERE( .*?)(?: (?:ORDER|GROUP|LIMIT|HAVING) |\z)"
    one_select = r"(?s)^ SELECT (?!.* (?:SELECT|JOIN|UNION) )"

    def of_clause(table: Column, line: Column, walked: Column) -> Column:
        preds = walked["preds"]
        equal = F.transform(F.filter(preds, lambda p: ~_is_range(p)), lambda p: p["col"])
        return F.struct(
            table["schema"].alias("schema"),
            table["table"].alias("table"),
            _restored_all(equal).alias("equality"),
            _restored(_first_range(preds)).alias("range"),
            _restored_all(_order_columns(line)).alias("order_by"),
            _restored_all(walked["wrapped"]).alias("wrapped_columns"),
        )

    def of_parts(p: Column, line: Column) -> Column:
        judged = p["table"]["table"].isNotNull() & ~F.contains(p["clause"], F.lit(" OR "))
        return F.when(judged, let(_walk(p["clause"]), lambda walked: of_clause(p["table"], line, walked)))

    def of_line(line: Column) -> Column:
        parts = F.struct(
            _table(F.regexp_extract(line, r"(?s)^.*? FROM (.*)\z", 1)).alias("table"),
            F.concat(F.regexp_extract(line, where, 1), F.lit(" ")).alias("clause"),
        )
        return F.when(line.rlike(one_select), let(parts, lambda p: of_parts(p, line)))

    return let(token_line(sql), of_line)


def candidate_index(shape: Column) -> Column:
    """Equality columns, then the range column, or else the sort columns."""

    def wanted(s: Column) -> Column:
        tail = F.when(s["range"].isNotNull(), F.array(s["range"])).otherwise(s["order_by"])
        return let(F.concat(s["equality"], tail), dedupe)

    return let(shape, wanted)
