"""Exports byte by byte, and exact numbering."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import export as O
from tidewatch.operators.positions import number_rows

CELLS = [
    (1, None, "plain"),
    (2, "", " edge "),
    (3, 'a"b', "x,y"),
    (4, "line\nbreak", "cr\rhere"),
    (5, "tab\there", "é — ü"),
    (6, "back\\slash|pipe", "<b>&'"),
]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(CELLS, "id bigint, a string, b string")


def text_of(path) -> bytes:
    return b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))


def test_csv_file(grid, tmp_path):
    O.write_csv(grid, str(tmp_path / "out"), ["id"], bom=True)
    want = (
        "﻿id,a,b\r\n1,,plain\r\n2,\"\",\" edge \"\r\n3,\"a\"\"b\",\"x,y\"\r\n"
        "4,\"line\nbreak\",\"cr\rhere\"\r\n5,tab\there,é — ü\r\n6,back\\slash|pipe,<b>&'\r\n"
    )
    assert text_of(tmp_path / "out") == want.encode()


def test_json_array_parses_back(grid, tmp_path):
    O.write_lines(O.to_json(grid, ["id"]), str(tmp_path / "out"), ["part", "id"])
    back = json.loads(text_of(tmp_path / "out"))
    assert back == [{"id": str(i), "a": a, "b": b} for i, a, b in CELLS]


def test_ndjson_renames_repeated_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, None)], "id int, x int, y int, z string").toDF("id", "id", "id_2", "id")
    assert O.unique_names(["id", "id", "id_2", "id"]) == ["id", "id_3", "id_2", "id_4"]
    assert O.to_ndjson(df).first().line == '{"id":"1","id_3":"2","id_2":"3","id_4":null}'


def test_doubles_print_plainly(spark):
    df = spark.sql("SELECT explode(array(5D, 0.1D, 1.0E10D, 1.5E-7D, -2.25D)) AS v")
    assert [r.line for r in O.to_csv(df).collect()] == ["5", "0.1", "10000000000", "0.00000015", "-2.25"]


def test_markdown_per_group(spark):
    df = spark.createDataFrame(
        [("g", 1, "1.5", "a|b"), ("g", 2, None, "x\r\ny"), ("h", 1, "n/a", "é")], "g string, id int, num string, t string"
    )
    lines = [r.line for r in O.to_markdown(df, ["g"], ["id"]).orderBy("g", "part", "id").collect()]
    assert lines == [
        "|  id |    num | t      |",
        "| --: | -----: | ------ |",
        "|   1 |    1.5 | a\\|b   |",
        "|   2 | _NULL_ | x<br>y |",
        "|  id | num | t   |",
        "| --: | --- | --- |",
        "|   1 | n/a | é   |",
    ]


def test_html_escapes_and_counts(grid):
    lines = [r.line for r in O.to_html(grid.withColumn("g", F.lit(1)), ["g"], ["id"], "T<", ["id", "a", "b"]).orderBy("part", "id").collect()]
    assert lines[0].startswith("<table>\n  <caption>T&lt; — 6 rows</caption>")
    assert lines[1] == '    <tr><td>1</td><td class="null">NULL</td><td>plain</td></tr>'
    assert lines[6].endswith("<td>&lt;b&gt;&amp;&#39;</td></tr>")
    assert lines[7] == "  </tbody>\n</table>"


def test_inserts_in_exact_batches(spark):
    df = spark.range(0, 103).select("id", F.lit("it's").alias("v"))
    out = O.to_inserts(df, "s.t", ["id"], rows_per_statement=10, verb="replace").orderBy("statement_no").collect()
    assert len(out) == 11
    assert out[0].line.startswith("REPLACE INTO `s`.`t` (`id`, `v`) VALUES\n('0','it\\'s'),\n")
    assert [o.line.count("\n") for o in out] == [10] * 10 + [3]
    one = O.to_inserts(df.limit(2), "t", ["id"], rows_per_statement=0).collect()
    assert len(one) == 2


@pytest.mark.parametrize("name", ["", "a.b.c", "x" * 65, "a\nb", "a\0b"])
def test_bad_names_are_refused(spark, name):
    with pytest.raises(ValueError):
        O.to_inserts(spark.range(1), name, ["id"])


def test_dump_batches_by_rows_and_bytes(spark):
    df = spark.range(0, 450, numPartitions=1).select("id", F.lit(b"ok").alias("b"), (F.col("id") / 2).alias("h"))
    rows = [r.rows for r in O.dump_data(df, "t").collect()]
    assert rows == [200, 200, 50]
    wide = spark.range(0, 5, numPartitions=1).select("id", F.repeat(F.lit("x"), 300_000).alias("v"))
    assert [r.rows for r in O.dump_data(wide, "t").collect()] == [2, 2, 1]
    first = O.dump_data(df, "t").first().line
    assert first.startswith("INSERT INTO `t` (`id`, `b`, `h`) VALUES\n(0,'ok',0),\n(1,'ok',0.5),\n")
    raw = spark.createDataFrame([(bytearray(b"\xff\x00"),)], "b binary")
    assert O.dump_data(raw, "t").first().line.endswith("(0xFF00);")
    assert O.dump_data(df.limit(0), "t").count() == 0


def test_dump_writes_all_parts(spark, tmp_path):
    O.dump_tables({"t": spark.range(3), "u": spark.range(2)}, str(tmp_path / "d"), "s", "8.0.36", "now", only=["u"])
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["0-preamble", "1-u", "2-epilogue"]


def test_numbers_are_exact_under_skew(spark):
    df = spark.range(0, 30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 30).cast("string"))).alias("g"),
        "id",
    )
    out = number_rows(df, ["id"], ["g"])
    check = out.groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("row_no").alias("d"), F.min("row_no").alias("lo"),
        F.max("row_no").alias("hi"), F.max("row_count").alias("c"),
    )
    for r in check.collect():
        assert (r.d, r.lo, r.hi, r.c) == (r.n, 0, r.n - 1, r.n)
    hot = [r.id for r in out.where("g = 'hot'").orderBy("row_no").limit(50).collect()]
    assert hot == sorted(hot)


def test_to_json_is_valid_when_order_keys_repeat(spark):
    rows = spark.createDataFrame([(k // 3, f"v{k}") for k in range(10)], "k long, v string")
    lines = O.to_json(rows, order=["k"]).orderBy("part", "k", "row_no").collect()
    parsed = json.loads("\n".join(r.line for r in lines))
    assert sorted(x["v"] for x in parsed) == sorted(f"v{k}" for k in range(10))


def test_dump_reports_what_it_wrote(spark, tmp_path):
    """Rows, statements and bytes come from the write and equal the files; statements end where they must."""
    rows = spark.range(0, 2500, 1, 3).selectExpr("id", "concat('it\\'s ', id) AS name", "IF(id % 7 = 0, double('NaN'), id / 7) AS ratio")
    home = str(tmp_path / "dump")
    stats = {r.table: r for r in O.dump_tables({"a": rows, "b": rows.where("id < 0")}, home, "shop", "9.9", "now").collect()}
    lines = [line for f in sorted((tmp_path / "dump" / "1-a").glob("part-*")) for line in f.read_text().splitlines()]
    assert stats["a"].bytes == sum(f.stat().st_size for f in (tmp_path / "dump" / "1-a").glob("part-*"))
    assert stats["a"].rows == 2500 and stats["a"].statements == sum(line.startswith("INSERT INTO") for line in lines)
    assert (stats["b"].rows, stats["b"].statements, stats["b"].bytes) == (0, 0, 0)
    assert not any("nan" in line.lower() for line in lines) and "(7,'it\\'s 7',NULL)" in [line.rstrip(",;") for line in lines]
    sizes = [s.rows for s in O.dump_data(rows, "a", batch_rows=100).collect()]
    # Each partition ends with a statement of its own; all others are full.
    assert sum(sizes) == 2500 and max(sizes) == 100 and sum(n < 100 for n in sizes) <= 3
    small = O.dump_data(rows, "a", batch_bytes=1000).collect()
    assert all(len(s.line) < 1300 for s in small) and sum(s.rows for s in small) == 2500


def test_only_finite_numbers_are_literals(spark):
    df = spark.sql("SELECT double('Infinity') AS a, double('-Infinity') AS b, float('NaN') AS c, 2.5e0 AS d, double(null) AS e")
    assert O.dump_data(df, "t").first().line.endswith("(NULL,NULL,NULL,2.5,NULL);")


def test_dump_statements_leave_one_by_one(spark, monkeypatch):
    """Each statement is given away as it ends, before more of the table is read."""
    steps = []
    whole = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, step, *a, **b: steps.append(step) or whole(df, step, *a, **b))
    O.dump_data(spark.range(1), "t", batch_rows=3, batch_bytes=100)
    read = []

    def batches():
        for rows in ([("(1)", 1), ("(2)", 1)], [("(3)", 1), ("(4)", 1), ("(5)", 200), ("(6)", 1)], [], [("(7)", 1)]):
            read.append(len(rows))
            yield pa.RecordBatch.from_pylist([{"values": v, "size": n} for v, n in rows], pa.schema({"values": pa.string(), "size": pa.int32()}))

    found = [(b.to_pylist(), len(read)) for b in steps[0](batches())]
    head = "INSERT INTO `t` (`id`) VALUES\n"
    assert found == [
        ([{"line": f"{head}(1),\n(2),\n(3);", "rows": 3}], 2),
        ([{"line": f"{head}(4),\n(5);", "rows": 2}], 2),
        ([{"line": f"{head}(6),\n(7);", "rows": 2}], 4),
    ]
