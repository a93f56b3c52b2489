"""Deadlocks out of storage-engine reports.

A report names both transactions, the locks each holds and waits for, and the
one rolled back. A server repeats its last deadlock in every report until the next one, so
sections are parsed once for each distinct text and joined back by hash, and
every table builds only the fields it shows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import let, lock_summary, pinned
from tidewatch.operators.distinct_texts import HASH, distinct_texts, parse_once, text_hash

REPORT_KEYS = ["server", "snapshot_ts"]

# Fixed patterns of the report layout.
HEADER = "LATEST DETECTED DEADLOCK"
_RULE = r"[ \t]*-{4,}[ \t\r]*"
AFTER_RULES = rf"(?s)^[^\n]*\n(?:{_RULE}(?:\n|\z))*+(.*)"
NEXT_RULE = rf"\n{_RULE}(?=\n|\z)"
MARKER = r"(?m)^[ \t]*\*\*\* "
LOCK_LINE = r"(?m)^[ \t]*((?:RECORD LOCKS|TABLE LOCK)[^\n]*)"
IS_LOCK_LINE = r"^(?:RECORD LOCKS|TABLE LOCK)"
BLANKS = " \t\n\x0b\f\r"
NOT_STATEMENT = r"^(?:\z|TRANSACTION |mysql tables in use|MySQL thread id)|lock struct\(s\)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _long(text: Column, pattern: str) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _first_filled(a: Column, b: Column) -> Column:
    """``b`` where ``a`` is empty; each is computed once at most."""
    return let(a, lambda v: F.when(v != "", v).otherwise(b))


def _lock_table(raw: Column) -> Column:
    table = _first_filled(F.regexp_extract(raw, r"of table (\S+)", 1), F.regexp_extract(raw, r"table (\S+)", 1))
    return F.translate(table, "`", "")


def lock_of(raw: Column) -> Column:
    """A lock line picked apart: table, index, mode with gap qualifiers."""
    mode = _first_filled(
        F.regexp_extract(raw, r"lock_mode (.*)\z", 1),
        F.regexp_extract(raw, r"lock mode (.*)\z", 1),
    )
    return F.struct(
        raw.alias("raw"),
        _lock_table(raw).alias("table"),
        F.regexp_extract(raw, r" index (\S+)", 1).alias("index"),
        _strip(F.regexp_replace(mode, r"(?: waiting)+\z", "")).alias("mode"),
        raw.startswith("RECORD LOCKS").alias("record"),
    )


def _block(text: Column) -> Column:
    """What follows one ``***`` marker: kind, party number and text."""
    head = F.regexp_extract(text, r"^([^\n]*)", 1)

    def of_number(n: Column) -> Column:
        kind = (
            F.when(n.isNull(), F.when(F.contains(head, F.lit("WE ROLL BACK TRANSACTION")), F.lit("victim")))
            .when(F.contains(head, F.lit("TRANSACTION:")), F.lit("party"))
            .when(F.contains(head, F.lit("HOLDS THE LOCK")), F.lit("holds"))
            .when(F.contains(head, F.lit("WAITING FOR THIS LOCK")), F.lit("waiting"))
        )
        return F.struct(kind.alias("kind"), n.alias("index"), text.alias("text"))

    number = F.regexp_extract(head, r"^\(([0-9]+)\)", 1)
    return let(F.nullif(number, F.lit("")).try_cast("int"), of_number)


def _of_kind(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: b["kind"] == kind)


def _lock_lines(blocks: Column, kind: str, index: Column) -> Column:
    """Lines of the locks listed for one party under its markers of one kind."""
    own = F.filter(blocks, lambda b: (b["kind"] == kind) & (b["index"] == index))
    lines = F.flatten(F.transform(own, lambda b: _all(b["text"], LOCK_LINE, 1)))
    return F.transform(lines, _strip)


def _awaited_line(blocks: Column, index: Column) -> Column:
    """The last lock waited for is the one that closed the circle."""
    return F.try_element_at(_lock_lines(blocks, "waiting", index), F.lit(-1))


def _statement(text: Column) -> Column:
    """Lines between the thread line and the first lock line."""
    after = F.regexp_extract(text, r"(?s)MySQL thread id [^\n]*\n(.*)\z", 1)

    def of_lines(lines: Column) -> Column:
        first_lock = F.array_position(F.transform(lines, lambda ln: ln.rlike(IS_LOCK_LINE)), True)
        upto = F.when(first_lock > 0, (first_lock - 1).cast("int")).otherwise(F.size(lines))
        kept = F.filter(F.slice(lines, F.lit(1), upto), lambda ln: ~ln.rlike(NOT_STATEMENT))
        return F.array_join(kept, "\n")

    return let(F.transform(F.split(after, "\n"), _strip), of_lines)


def _thread(text: Column) -> Column:
    """Thread id and the words after the query id: nothing, a user, or host,
    user and state."""
    line = F.regexp_extract(text, r"(?m)^[ \t]*(MySQL thread id [^\n]*)", 1)

    def of_words(words: Column) -> Column:
        empty = F.lit("")
        first, second = (F.coalesce(F.get(words, F.lit(i)), empty) for i in (0, 1))
        alone = F.size(words) == 1
        return F.struct(
            F.when(alone, empty).otherwise(first).alias("host"),
            F.when(alone, first).otherwise(second).alias("user"),
            F.array_join(
                F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(3))), " "
            ).alias("state"),
            _long(text, r"MySQL thread id [^0-9\n]*([0-9]+)").alias("id"),
        )

    words = F.split(F.regexp_extract(line, r"query id \S+(.*)", 1), r"\s+")
    return let(F.filter(words, lambda w: w != ""), of_words)


#: Fields of a party that are flat, in their order, and those that hold its locks.
PARTY_FIELDS = [
    "trx_id", "active_secs", "activity", "thread_id", "host", "user", "state", "tables_in_use",
    "tables_locked", "lock_structs", "row_locks", "query",
]
LOCK_FIELDS = ["holds", "waiting"]
_THREAD_FIELDS = {"thread_id": "id", "host": "host", "user": "user", "state": "state"}


def _party(block: Column, blocks: Column, fields: Sequence[str]) -> Column:
    """``index`` and the wanted fields of one party; no other is computed."""
    text, index = block["text"], block["index"]
    head = F.regexp_extract(text, r"(?m)^[ \t]*(TRANSACTION [^\n]*)", 1)

    def waiting() -> Column:
        return let(_awaited_line(blocks, index), lambda line: F.when(line.isNotNull(), lock_of(line)))

    def tables() -> Column:
        lines = F.concat(_lock_lines(blocks, "holds", index), F.array_compact(F.array(_awaited_line(blocks, index))))
        return F.transform(lines, _lock_table)

    make = {
        "trx_id": lambda: F.regexp_replace(
            F.regexp_extract(head, r"TRANSACTION ([^,]*)", 1), r"^\s+|[^A-Za-z0-9]+\z", ""
        ),
        "active_secs": lambda: _long(head, r"ACTIVE [^0-9]*([0-9]+)"),
        "activity": lambda: _strip(F.regexp_extract(head, r" sec (.*)", 1)),
        "tables_in_use": lambda: _long(text, r"(?m)^[ \t]*mysql tables in use [^0-9\n]*([0-9]+)"),
        "tables_locked": lambda: _long(text, r"(?m)^[ \t]*mysql tables in use[^\n]*locked [^0-9\n]*([0-9]+)"),
        "lock_structs": lambda: _long(text, r"([0-9]+)[ \t]+lock struct\(s\)"),
        "row_locks": lambda: _long(text, r"lock struct\(s\)[^\n]*?([0-9]+)[ \t]+row"),
        "query": lambda: _statement(text),
        "holds": lambda: F.transform(_lock_lines(blocks, "holds", index), lock_of),
        "waiting": waiting,
        "tables": tables,
    }

    def of_thread(thread: Column | None) -> Column:
        built = [(thread[_THREAD_FIELDS[f]] if f in _THREAD_FIELDS else make[f]()).alias(f) for f in fields]
        return F.struct(index.alias("index"), *built)

    if _THREAD_FIELDS.keys() & set(fields):
        return let(_thread(text), of_thread)
    return of_thread(None)


def deadlock_sections(reports: DataFrame) -> DataFrame:
    """Deadlock part of each report that has one."""
    some = reports.where(F.contains("report", F.lit(HEADER))).select(*REPORT_KEYS, "report")
    # What follows the header, so that the patterns start where they match.
    tail = F.substr("report", F.instr("report", HEADER) + F.lit(len(HEADER)))
    cut = pinned(some, "section", F.get(F.split(F.regexp_extract(tail, AFTER_RULES, 1), NEXT_RULE, 2), F.lit(0)))
    return cut.where(F.col("section") != "").select(*REPORT_KEYS, "section")


def _parsed(texts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct sections with detected_at, victim and their parties' ``fields``, where there is a party."""
    cut = pinned(texts, "pieces", F.split("section", MARKER))
    after_markers = F.slice("pieces", F.lit(2), F.size("pieces"))
    cut = pinned(cut, "blocks", F.transform(after_markers, _block))
    parties = _of_kind(F.col("blocks"), "party")
    cut = cut.where(F.size(parties) > 0)
    verdict = F.try_element_at(_of_kind(F.col("blocks"), "victim"), F.lit(-1))["text"]
    named = F.transform(parties, lambda b: _party(b, F.col("blocks"), fields))
    found = pinned(cut, "parties", named) if fields else cut
    return found.select(
        HASH,
        "section",
        _strip(F.regexp_extract(F.get("pieces", F.lit(0)), r"^\s*([^\n]*)", 1)).alias("detected_at"),
        F.nullif(F.regexp_extract(verdict, r"^[^\n]*\(([0-9]+)\)", 1), F.lit("")).try_cast("int").alias("victim"),
        *(["parties"] if fields else []),
    )


def _of_sections(sections: DataFrame, fields: Sequence[str]) -> DataFrame:
    return parse_once(sections, "section", lambda texts: _parsed(texts, fields))


def deadlocks(sections: DataFrame) -> DataFrame:
    """One nested row per report that shows a deadlock, with everything known of its parties."""
    return _of_sections(sections, [*PARTY_FIELDS, *LOCK_FIELDS])


def deadlock_parties(sections: DataFrame) -> DataFrame:
    parsed = _of_sections(sections, PARTY_FIELDS)
    return parsed.select(*REPORT_KEYS, "detected_at", "victim", F.explode("parties").alias("p")).select(
        *REPORT_KEYS,
        "detected_at",
        F.col("p.index").alias("party"),
        *[F.col(f"p.{f}").alias(f) for f in PARTY_FIELDS],
        F.coalesce(F.col("p.index") == F.col("victim"), F.lit(False)).alias("rolled_back"),
    )


def deadlock_locks(sections: DataFrame) -> DataFrame:
    """Held and awaited locks, one row each, in report order."""

    def role(locks: Column, name: str) -> Column:
        return F.transform(
            locks, lambda lk, i: F.struct(F.lit(name).alias("role"), i.alias("pos"), lk.alias("lock"))
        )

    p = F.col("p")
    awaited = F.array_compact(F.array(p["waiting"]))
    exploded = (
        _of_sections(sections, LOCK_FIELDS)
        .select(*REPORT_KEYS, F.explode("parties").alias("p"))
        .select(
            *REPORT_KEYS,
            p["index"].alias("party"),
            F.explode(F.concat(role(p["holds"], "holds"), role(awaited, "waiting"))).alias("x"),
        )
        .select(*REPORT_KEYS, "party", "x.role", "x.pos", "x.lock.*")
    )
    return exploded.withColumn(
        "summary", lock_summary(F.col("record"), F.col("table"), F.col("index"), F.col("mode"))
    )


def deadlock_victim(sections: DataFrame) -> DataFrame:
    return _of_sections(sections, []).select(*REPORT_KEYS, "detected_at", "victim")


def deadlock_tables(sections: DataFrame) -> DataFrame:
    """Tables of any lock on either side, each once, in report order."""
    parsed = _of_sections(sections, ["tables"])
    named = F.flatten(F.transform("parties", lambda p: p["tables"]))
    distinct = F.array_distinct(F.filter(named, lambda t: t != ""))
    return parsed.select(*REPORT_KEYS, "detected_at", distinct.alias("tables"))


def deadlock_history(sections: DataFrame) -> DataFrame:
    """Each deadlock once, however many snapshots repeat it.

    A server remembers only its latest deadlock; snapshots keep them all. Repeats of one text on one server are
    counted first, and of the parties only their transactions are read.
    """
    counted = (
        sections.groupBy("server", text_hash(F.col("section")).alias(HASH))
        .agg(
            F.min("snapshot_ts").alias("first_seen"),
            F.max("snapshot_ts").alias("last_seen"),
            F.count(F.lit(1)).alias("snapshots"),
        )
    )
    parsed = _parsed(distinct_texts(sections, "section"), ["trx_id"])
    trx_ids = F.array_sort(F.transform("parties", lambda p: p["trx_id"])).alias("trx_ids")
    return (
        counted.join(parsed.select(HASH, "detected_at", "victim", trx_ids), HASH)
        .groupBy("server", "detected_at", "trx_ids")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min_by("victim", "first_seen").alias("victim"),
            F.sum("snapshots").alias("snapshots"),
        )
    )
