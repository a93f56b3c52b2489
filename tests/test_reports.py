"""Engine reports in both layouts, and deadlocks."""

from __future__ import annotations

import datetime as dt

from tidewatch.operators import deadlocks as X
from tidewatch.operators.reports import checkpoint_age, log_flush_lag, parse_engine_reports

NEW = """
=====================================
2031-07-08 21:15:40 4 INNODB MONITOR OUTPUT
BACKGROUND THREAD
srv_master_thread loops: 12 srv_active, 0 srv_shutdown, 90 srv_idle
OS WAIT ARRAY INFO: reservation count 412
RW-shared spins 3, rounds 5, OS waits 1
TRANSACTIONS
Trx id counter 90818
History list length 5678
FILE I/O
0.00 reads/s, 0 avg bytes/read, 7.50 writes/s
LOG
Log sequence number          700000250
Log flushed up to            700000000
Pages flushed up to          698000000
Last checkpoint at           697000000
3 pending log flushes, 0 pending chkp writes
BUFFER POOL AND MEMORY
Total large memory allocated 137363456
Buffer pool size   0
Buffer pool size   32768
Free buffers       21
Database pages     30011
Modified db pages  654
Pending reads      2
ROW OPERATIONS
Buffer pool size   4096
"""
OLD = """
History list length 8
Log sequence number 900
Log flushed up to   950
Last checkpoint at  1000.
Buffer pool size, bytes 2000
Free buffers
Modified db pages  31, rest later
"""

DEADLOCK = """header
------------------------
LATEST DETECTED DEADLOCK
------------------------
2026-03-04 05:06:07 0x7f00
*** (1) TRANSACTION:
TRANSACTION 71, ACTIVE 12 sec fetching rows
mysql tables in use 2, locked 1
LOCK WAIT 4 lock struct(s), heap size 1136, 9 row lock(s), undo log entries 3
MySQL thread id 31, OS thread handle 0x1, query id 5 localhost root
SELECT *

  FROM t FOR UPDATE
*** (1) WAITING FOR THIS LOCK TO BE GRANTED:
RECORD LOCKS space id 1 page no 4 n bits 72 index ix_a of table `d`.`t` trx id 71 lock_mode X locks gap before rec waiting
Record lock, heap no 2 PHYSICAL RECORD: n_fields 3
 0: len 4; hex 80000001; asc     ;;
*** (2) TRANSACTION:
TRANSACTION 72, ACTIVE 1 sec
MySQL thread id 32, OS thread handle 0x1, query id 6 solo
LOCK TABLES d.u WRITE
*** (2) HOLDS THE LOCK(S):
TABLE LOCK table `d`.`u` trx id 72 lock mode IX
RECORD LOCKS space id 1 page no 4 n bits 72 index PRIMARY of table `d`.`t` trx id 72 lock_mode S
*** (2) WAITING FOR THIS LOCK TO BE GRANTED:
RECORD LOCKS space id 1 page no 4 n bits 72 index PRIMARY of table `d`.`t` trx id 72 lock_mode X
RECORD LOCKS space id 1 page no 5 n bits 72 index ix_b of table `d`.`t` trx id 72 lock_mode X waiting
*** (3) HOLDS THE LOCK(S):
TABLE LOCK table `d`.`nobody` trx id 99 lock mode X
*** WE ROLL BACK TRANSACTION (2)
------------
TRANSACTIONS
------------
TRANSACTION 99, not started
"""


def reports(spark, *texts):
    now = dt.datetime(2026, 1, 2, 3, 4, 5)
    return spark.createDataFrame(
        [(f"s{i}", now, t) for i, t in enumerate(texts)],
        "server string, snapshot_ts timestamp, report string",
    )


def test_numbers_of_both_layouts(spark):
    parsed = parse_engine_reports(reports(spark, NEW, OLD, "", "garbage\nLog sequence number x"))
    rows = {r.server: r.asDict() for r in parsed.withColumns({"age": checkpoint_age(), "lag": log_flush_lag()}).collect()}
    new = {k: int(v) for k, v in rows["s0"].items() if k not in ("server", "snapshot_ts")}
    assert new == {
        "history_list_length": 5678, "lsn": 700000250, "log_flushed_up_to": 700000000,
        "pages_flushed_up_to": 698000000, "last_checkpoint": 697000000, "buffer_pool_pages": 32768,
        "free_buffers": 21, "database_pages": 30011, "modified_pages": 654,
        "os_wait_reservations": 412, "age": 3000250, "lag": 250,
    }
    old = rows["s1"]
    assert (old["history_list_length"], old["last_checkpoint"], old["modified_pages"]) == (8, 1000, 31)
    assert old["buffer_pool_pages"] == 2000 and old["free_buffers"] == 0
    assert old["age"] == 0 and old["lag"] == 0  # never below zero
    for s in ("s2", "s3"):
        assert all(v == 0 for k, v in rows[s].items() if k not in ("server", "snapshot_ts"))


def test_deadlock_parties(spark):
    sections = X.deadlock_sections(reports(spark, DEADLOCK, NEW, DEADLOCK.split("*** (1)")[0]))
    assert X.deadlocks(sections).count() == 1
    one, two = X.deadlock_parties(sections).orderBy("party").collect()
    assert one.detected_at == "2026-03-04 05:06:07 0x7f00"
    assert (one.trx_id, one.active_secs, one.activity) == ("71", 12, "fetching rows")
    assert (one.thread_id, one.host, one.user, one.state) == (31, "localhost", "root", "")
    assert (one.tables_in_use, one.tables_locked, one.lock_structs, one.row_locks) == (2, 1, 4, 9)
    assert one.query == "SELECT *\nFROM t FOR UPDATE" and not one.rolled_back
    assert (two.host, two.user, two.activity) == ("", "solo", "") and two.rolled_back
    assert two.query == "LOCK TABLES d.u WRITE"


def test_deadlock_locks(spark):
    parsed = X.deadlock_sections(reports(spark, DEADLOCK))
    got = [
        (r.party, r.role, r.table, r["index"], r.mode, r.record)
        for r in X.deadlock_locks(parsed).orderBy("party", "role", "pos").collect()
    ]
    assert got == [
        (1, "waiting", "d.t", "ix_a", "X locks gap before rec", True),
        (2, "holds", "d.u", "", "IX", False),
        (2, "holds", "d.t", "PRIMARY", "S", True),
        (2, "waiting", "d.t", "ix_b", "X", True),  # the last one waited for
    ]
    assert X.deadlock_tables(parsed).first().tables == ["d.t", "d.u"]
    assert X.deadlock_victim(parsed).first().victim == 2


def test_section_ends_at_the_next_rule(spark):
    section = X.deadlock_sections(reports(spark, DEADLOCK)).first().section
    assert section.startswith("2026-03-04") and section.endswith("WE ROLL BACK TRANSACTION (2)")


def test_long_hex_dumps_do_not_matter(spark):
    dump = "\n".join(f" {i}: len 4; hex {i:08x}; asc     ;;" for i in range(20_000))
    text = DEADLOCK.replace("Record lock, heap no 2 PHYSICAL RECORD: n_fields 3", dump)
    assert X.deadlock_parties(X.deadlock_sections(reports(spark, text))).count() == 2


def test_repeated_sections_are_parsed_once(spark):
    """Many snapshots of one deadlock: equal rows for each, one history row, and the parse above the aggregate."""
    other = DEADLOCK.replace("TRANSACTION 71", "TRANSACTION 70")
    start = dt.datetime(2026, 1, 2)
    rows = [("a", start + dt.timedelta(minutes=k), other if k == 5 else DEADLOCK) for k in range(8)]
    rows += [("b", start, DEADLOCK), ("b", start, None), ("b", start, "")]
    frame = spark.createDataFrame(rows, "server string, snapshot_ts timestamp, report string")
    sections = X.deadlock_sections(frame)
    assert X.deadlock_parties(sections).count() == 18 and X.deadlock_victim(sections).count() == 9
    history = sorted((r.server, r.trx_ids, r.first_seen.minute, r.last_seen.minute, r.victim, r.snapshots) for r in X.deadlock_history(sections).collect())
    assert history == [("a", ["70", "72"], 5, 5, 2, 1), ("a", ["71", "72"], 0, 7, 2, 7), ("b", ["71", "72"], 0, 0, 2, 1)]
    assert parse_engine_reports(frame).count() == 11

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString().splitlines()

    def first(lines, part):
        return next(k for k, line in enumerate(lines) if part in line)

    for df, mark in ((X.deadlock_parties(sections), "lock struct"), (X.deadlock_history(sections), "ACTIVE|TRANSACTION"), (parse_engine_reports(frame), "History list")):
        lines = plan(df)
        marks = [k for k, line in enumerate(lines) if any(m in line for m in mark.split("|"))]
        # A parent is printed above its child.
        assert max(marks) < first(lines, "Aggregate [_text_hash") and marks
    assert not any("lock struct" in line or "thread id" in line for line in plan(X.deadlock_history(sections)))
    assert not any("thread id" in line for line in plan(X.deadlock_tables(sections)))


def test_lock_lines_are_cut_once(spark):
    """One cut of the lines held and one of those awaited, however many fields are read from them."""
    found = X.deadlock_locks(X.deadlock_sections(reports(spark, DEADLOCK)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RECORD LOCKS|TABLE LOCK") == 2


def test_blanks_around_lock_lines(spark):
    spaced = DEADLOCK.replace("RECORD LOCKS", " \t RECORD LOCKS").replace("lock mode S\n", "lock mode S \t\x0b\f\r\n")
    rows = X.deadlock_locks(X.deadlock_sections(reports(spark, spaced))).orderBy("party", "role", "pos").collect()
    assert [(r.raw[:6], r.mode) for r in rows] == [("RECORD", "X locks gap before rec"), ("TABLE ", "IX"), ("RECORD", "S"), ("RECORD", "X")]
