"""Statement shapes, candidates and what becomes of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.shapes import candidate_index, statement_shape

# statement, (schema, table, equality, range, order_by, wrapped), candidate
JUDGED = [
    ("SELECT level FROM readings WHERE gauge = ? AND taken < ?", (None, "readings", ["gauge"], "taken", [], []), ["gauge", "taken"]),
    (
        "select level from `tide` . `readings` as r where r.taken between ? and ? and `r`.`gauge` = ?",
        ("tide", "readings", ["gauge"], "taken", [], []),
        ["gauge", "taken"],
    ),
    (
        "SELECT no FROM berths WHERE harbour = ? AND pier <=> ? ORDER BY depth DESC, no ASC LIMIT 3",
        (None, "berths", ["harbour", "pier"], None, ["depth", "no"], []),
        ["harbour", "pier", "depth", "no"],
    ),
    ("SELECT no FROM berths WHERE depth > ? AND pier = ? ORDER BY no", (None, "berths", ["pier"], "depth", ["no"], []), ["pier", "depth"]),
    ("SELECT id FROM ships WHERE name LIKE ? AND flag IN (?, ?)", (None, "ships", ["flag"], "name", [], []), ["flag", "name"]),
    ("SELECT id FROM ships WHERE pilot = ? AND HOUR(`docked at`) < ?", (None, "ships", ["pilot"], None, [], ["docked at"]), ["pilot"]),
    ("SELECT id FROM ships WHERE ABS(FLOOR(SQRT(beam, ?), ?), hull) = ? AND yard = ?", (None, "ships", ["yard"], None, [], ["FLOOR"]), ["yard"]),
    ("SELECT id FROM ships WHERE yard >= UPPER(?, crew) AND IFNULL(?, hull) = ?", (None, "ships", [], "yard", [], []), ["yard"]),
    ("SELECT id FROM ships WHERE (((flag = ?)) AND ((beam <= ?)))", (None, "ships", ["flag"], "beam", [], []), ["flag", "beam"]),
    ("SELECT id FROM ships WHERE `call sign` >= ? AND `union` = ?", (None, "ships", ["union"], "call sign", [], []), ["union", "call sign"]),
    ("SELECT id FROM ships WHERE `no``1` = ? AND `len(m)` = ?", (None, "ships", ["no`1", "len(m)"], None, [], []), ["no`1", "len(m)"]),
    ("SELECT id FROM ships WHERE Beam < ? AND yard = ? AND YARD < ?", (None, "ships", ["yard"], "Beam", [], []), ["yard", "Beam"]),
    ("SELECT id FROM ships WHERE yard = ? AND YARD < ? AND beam < ?", (None, "ships", ["yard"], "beam", [], []), ["yard", "beam"]),
    ("SELECT id FROM ships WHERE beam <= ? AND beam = ?", (None, "ships", ["beam"], "beam", [], []), ["beam"]),
    ("SELECT id FROM ships WHERE lost IS NULL AND sold IS NOT NULL AND crew != ?", (None, "ships", ["lost"], None, [], []), ["lost"]),
    ("SELECT id FROM ships WHERE yard = ? ORDER BY built, length(name), id", (None, "ships", ["yard"], None, ["built"], []), ["yard", "built"]),
    ("SELECT flag FROM ships GROUP BY flag HAVING count(*) > ?", (None, "ships", [], None, [], []), []),
    ("SELECT name FROM ships LIMIT ?", (None, "ships", [], None, [], []), []),
    ("SELECT name FROM ships WHERE MONTH(built", (None, "ships", [], None, [], ["built"]), []),
]
SKIPPED = [
    "SELECT s.name FROM ships s INNER JOIN calls c ON c.ship = s.id WHERE c.port = ?",
    "SELECT name FROM ships WHERE crew > ? OR beam > ?",
    "SELECT name FROM ships WHERE id = (SELECT max(ship) FROM calls)",
    "SELECT name FROM ships, calls WHERE calls.ship = ships.id",
    "SELECT name FROM port.ships s, calls WHERE ship = id",
    "SELECT name FROM ships UNION ALL SELECT name FROM wrecks",
    "DELETE FROM calls WHERE gone < ?",
    "INSERT INTO calls VALUES (?, ?)",
    "SELECT now()",
    "SELECT name FROM port . WHERE id = ?",
    "   ",
]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(s,) for s, _, _ in JUDGED] + [(s,) for s in SKIPPED]
    df = spark.createDataFrame(rows, "sql string").withColumn("shape", statement_shape(F.col("sql")))
    return {r.sql: r for r in df.withColumn("cand", candidate_index(F.col("shape"))).collect()}


@pytest.mark.parametrize(("sql", "want", "candidate"), JUDGED)
def test_judged(shapes, sql, want, candidate):
    r = shapes[sql]
    assert tuple(r.shape) == want
    assert r.cand == candidate


@pytest.mark.parametrize("sql", SKIPPED)
def test_skipped(shapes, sql):
    assert shapes[sql].shape is None


def test_deep_parentheses_take_linear_time(spark):
    """2,000 nested groups and 2,000 nested calls, in far less than a round for each."""
    import time

    def statement(n, call=""):
        return f"SELECT id FROM ships WHERE yard = ? AND {(call + '(') * n}beam < ?{')' * n} AND flag = ?"

    def seconds(sqls):
        df = spark.createDataFrame([(s,) for s in sqls], "sql string").select(statement_shape(F.col("sql")).alias("s"))
        start = time.monotonic()
        rows = [r.s for r in df.collect()]
        return time.monotonic() - start, rows

    seconds([statement(3)])
    small, _ = seconds([statement(250)] * 40)
    large, rows = seconds([statement(2000)] * 40)
    assert large < 8 * small + 4
    assert (rows[0].equality, rows[0].range) == (["yard", "flag"], "beam")
    _, (shape,) = seconds([statement(2000, "ABS ")])
    assert (shape.equality, shape.range, shape.wrapped_columns) == (["yard", "flag"], None, ["ABS"])


def test_repeated_texts_are_parsed_once(spark):
    from tidewatch.operators.suggest import statement_shapes

    schema = "server string, digest string, digest_text string, text string, count long"
    sql = "SELECT no FROM berths WHERE pier = ?"
    rows = [(f"s{k}", "d", sql, "", 20) for k in range(9)] + [("s", "e", None, sql, 1), ("s", "f", None, None, 1)]
    shaped = statement_shapes(spark.createDataFrame(rows, schema))
    lines = shaped._jdf.queryExecution().optimizedPlan().toString().splitlines()
    walk = max(k for k, line in enumerate(lines) if "aggregate(" in line)
    assert walk < next(k for k, line in enumerate(lines) if "Aggregate [_text_hash" in line)
    got = shaped.collect()
    assert len(got) == 11 and [r.candidate for r in got].count(["pier"]) == 10
