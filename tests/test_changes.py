"""Change sets against a dictionary, entry by entry."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import changes as H

BASE = "a int, b string, x string, n bigint"


def log_df(spark, entries):
    rows = [
        (i, op, [(c, None if v is None else str(v)) for c, v in key], [(c, None if v is None else str(v)) for c, v in vals])
        for i, (op, key, vals) in enumerate(entries)
    ]
    return spark.createDataFrame(rows, H.CHANGE_LOG)


def random_batch(seed: int):
    rng = random.Random(seed)
    keys = [(1, "p"), (1, None), (2, "p"), (3, "q"), (None, "r"), (4, "s")]
    table = {k: (f"x{i}", i) for i, k in enumerate(keys[:4])}
    base, live, log, affected = dict(table), dict(table), [], 0
    for _ in range(60):
        k = rng.choice(keys[:2] + keys)
        key = [("a", k[0]), ("b", k[1])]
        op = rng.choice(["update", "update", "update", "delete", "insert"])
        if op == "update":
            col = rng.choice(["x", "n"])
            value = rng.choice([None, rng.randrange(100)])
            if k in live:
                affected += 1
                x, n = live[k]
                live[k] = (None if value is None else str(value), n) if col == "x" else (x, value)
            log.append(("update", key, [(col, value)]))
        elif op == "delete":
            affected += live.pop(k, None) is not None
            log.append(("delete", key, []))
        elif k not in live:
            n = rng.randrange(100)
            live[k] = (None, n)
            affected += 1
            log.append(("insert", [], [*key, ("n", n)]))
    return base, live, log, affected


@pytest.mark.parametrize("seed", range(3))
def test_matches_a_dictionary(spark, seed, monkeypatch):
    monkeypatch.setattr(H, "SEQ_CHUNK", 7)
    base, live, log, affected = random_batch(seed)
    df = spark.createDataFrame([(*k, *v) for k, v in base.items()], BASE)
    changes = log_df(spark, log)
    out = H.apply_changes(df, changes, ["a", "b"])
    assert {(r.a, r.b): (r.x, r.n) for r in out.collect()} == live
    assert H.affected_rows(df, changes, ["a", "b"]).first().affected == affected


@pytest.mark.parametrize(
    ("entry", "error"),
    [
        (("insert", [], [("a", 1), ("b", "p"), ("x", "y")]), "duplicate key"),
        (("update", [("a", 1)], [("x", "y")]), "no primary key"),
        (("delete", [], []), "no primary key"),
        (("update", [("a", 1), ("b", "p")], [("zz", "y")]), "unknown column"),
        (("update", [("a", 1), ("b", "p")], []), "no values"),
        (("merge", [("a", 1), ("b", "p")], [("x", "y")]), "unknown operation"),
    ],
)
@pytest.mark.parametrize("read", ["collect", "count"])
def test_one_bad_entry_stops_the_batch(spark, entry, error, read):
    df = spark.createDataFrame([(1, "p", "x", 1)], BASE)
    good = ("update", [("a", 1), ("b", "p")], [("x", "fine")])
    out = H.apply_changes(df, log_df(spark, [good, entry]), ["a", "b"])
    with pytest.raises(Exception, match=error):
        getattr(out, read)()


@pytest.mark.parametrize("chunk", [2, 100])
@pytest.mark.parametrize(
    ("ops", "bad"),
    [("ID", None), ("IDI", None), ("IuIu", 2), ("IuuuuuI", 6), ("DI", None), ("IDII", 3), ("uuIDuI", None)],
)
def test_inserts_meet_what_is_there(spark, monkeypatch, chunk, ops, bad):
    """A second insert of a key fails, also when updates lie between and in another piece of the log."""
    monkeypatch.setattr(H, "SEQ_CHUNK", chunk)
    key = [("a", 9), ("b", "z")]
    entries = [{"I": ("insert", [], [*key, ("n", k)]), "D": ("delete", key, []), "u": ("update", key, [("n", k)])}[o] for k, o in enumerate(ops)]
    log, base = log_df(spark, entries), spark.createDataFrame([(1, "p", "x", 1)], BASE)
    errors = [r.seq for r in H.change_errors(base, log, ["a", "b"]).orderBy("seq").collect()]
    assert errors[:1] == ([] if bad is None else [bad])
    out = H.apply_changes(base, log, ["a", "b"])
    if bad is None:
        assert out.count() == 1 + (ops.replace("u", "")[-1] == "I")
    else:
        with pytest.raises(Exception, match=rf"change {bad} \(insert\): duplicate key"):
            out.collect()


def test_one_pass_over_the_log_and_no_job_before_it(spark):
    """The plan reads the log once, and building it starts no job."""
    base, log = spark.createDataFrame([(1, "p", "x", 1)], BASE), log_df(spark, [("delete", [("a", 1), ("b", "p")], [])])
    spark.sparkContext.setJobGroup("building", "apply_changes")
    out = H.apply_changes(base, log, ["a", "b"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_no_key_is_refused(spark):
    with pytest.raises(ValueError):
        H.apply_changes(spark.createDataFrame([(1, "p", "x", 1)], BASE), log_df(spark, []), [])


def test_preview_quotes_values(spark):
    entries = [
        ("update", [("id", "1' OR '1'='1")], [("na`me", "what? it's")]),
        ("delete", [("id", None)], []),
        ("insert", [], [("a", None), ("b", "?")]),
        ("delete", [], []),
        ("insert", [], []),
    ]
    df = log_df(spark, entries).orderBy("seq").select(H.change_preview(F.lit("s"), F.lit("t")).alias("p"))
    assert [r.p for r in df.collect()] == [
        "UPDATE `s`.`t` SET `na``me` = 'what? it''s' WHERE `id` <=> '1'' OR ''1''=''1' LIMIT 1",
        "DELETE FROM `s`.`t` WHERE `id` <=> NULL LIMIT 1",
        "INSERT INTO `s`.`t` (`a`, `b`) VALUES (NULL, '?')",
        "-- refusing to DELETE without a primary key",
        "-- nothing to insert",
    ]
