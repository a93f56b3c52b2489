"""Display text and keys, value by value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch import functions as T
from tidewatch.plans import catalogue


def run(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("host", "key"),
    [
        ("10.0.0.7:51234", "10.0.0.7"), ("web.lan:1", "web.lan"), ("localhost", "localhost"),
        ("[::1]:3306", "::1"), ("[fe80::1]", "fe80::1"), ("::1", "::1"), ("fe80::1:22", "fe80::1:22"),
        ("h:", "h:"), (":80", ":80"), ("h:8a", "h:8a"), ("", "(unknown)"), (None, "(unknown)"), ("[x", "[x"),
    ],
)
def test_host_key(spark, host, key):
    assert run(spark, host, "string", T.host_key) == key


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT 1", "read"), ("  (select 1)", "read"), ("-- x\n# y\n/* z */ delete from t", "write"),
        ("/* select */ DROP TABLE t", "ddl"), ("-- only", "unknown"), ("", "unknown"), ("frob", "unknown"),
        ("EXPLAIN ANALYZE DELETE FROM t", "read"), ("/* open", "unknown"), ("call p()", "write"),
    ],
)
def test_statement_kind(spark, sql, kind):
    assert run(spark, sql, "string", T.statement_kind) == kind


@pytest.mark.parametrize(
    ("fn", "value", "text"),
    [
        (T.fmt_bytes, 0.0, "0.0 B"), (T.fmt_bytes, 1280.0, "1.2 KiB"), (T.fmt_bytes, 1536.0, "1.5 KiB"),
        (T.fmt_bytes, 5.0 * 1024**4, "5.0 TiB"), (T.fmt_bytes, 9.0 * 1024**5, "9216.0 TiB"),
        (T.fmt_ms, 0.5, "500 µs"), (T.fmt_ms, 3255.0, "3.25 s"), (T.fmt_ms, 1.25, "1.2 ms"),
        (T.fmt_ms, 90_000.0, "1.5 min"), (T.number_text, 5.0, "5"), (T.number_text, -0.5, "-0.5"),
    ],
)
def test_numbers(spark, fn, value, text):
    assert run(spark, value, "double", fn) == text


@pytest.mark.parametrize(
    ("fn", "value", "text"),
    [
        (T.fmt_count, 999, "999"), (T.fmt_count, 1500, "1.5k"), (T.fmt_count, 2_500_000, "2.5M"),
        (T.fmt_count, 7_000_000_000, "7.0B"), (T.fmt_duration, 59, "59s"), (T.fmt_duration, 61, "1m"),
        (T.fmt_duration, 3_700, "1h 1m"), (T.fmt_duration, 200_000, "2d 7h"),
    ],
)
def test_whole_numbers(spark, fn, value, text):
    assert run(spark, value, "bigint", fn) == text


def test_text(spark):
    assert run(spark, " a\n\t b  c ", "string", lambda c: T.one_line(c, 10)) == "a b c"
    assert run(spark, "abcdef", "string", lambda c: T.one_line(c, 3)) == "abc…"
    assert run(spark, "\\'\n\r\0\x1a", "string", T.escape_sql) == "\\\\\\'\\n\\r\\0\\Z"
    assert run(spark, "a\\|b\r\nc\rd\ne", "string", T.escape_markdown) == "a\\\\\\|b<br>c<br>d<br>e"
    assert run(spark, "my_db$1", "string", T.is_safe_ident)
    for bad in ("", "x`", "a b", "x" * 65, "ok\n"):
        assert not run(spark, bad, "string", T.is_safe_ident)
    assert run(spark, 86_399_999, "bigint", T.format_datetime) == "1970-01-01 23:59:59"
    assert run(spark, 0, "bigint", lambda c: T.format_datetime(c, "Asia/Tokyo")) == "1970-01-01 09:00:00"


def test_number_text_reads_back_equal(spark):
    values = [0.0, 0.1, 1 / 3, 0.30000000000000004, 1.5e-20, 1.2345678901234567e-7, -2.5e-5, 5e-324, 1.7976931348623157e308,
              1e15, 1.5e15, 123456789012345678.0, -9.875e20, 1e22, 12345.678, 1e7, 12345678.5, 0.001]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("text", T.number_text(F.col("v")))
    for row in df.collect():
        assert float(row.text) == row.v and "E" not in row.text.upper() and not row.text.endswith(".0"), row
    small = spark.sql("SELECT CAST(0.1 AS FLOAT) AS v").select(T.number_text(F.col("v")).alias("text")).first()
    assert small.text == "0.1"


def test_numbers_beyond_64_bits(spark, tmp_path):
    """Keys of larger tables: their products no longer fit 64 bits."""
    keys = [0, 3, 7, 499_279, 499_280, 499_283, 899_998, 899_999, 900_000, 53_999_999, 400_000_001, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    big = {k: k * k * 37 * (1, 1000, 1_000_000)[k % 3] for k in keys if k is not None}

    def in_steps(v, steps):
        return next(f"{v / at:.1f}{unit}" for at, below, unit in steps if v < below)

    size = [(1024**p, 1024 ** (p + 1) if p < 4 else float("inf"), f" {u}") for p, u in enumerate(["B", "KiB", "MiB", "GiB", "TiB"])]
    count = [(1e3, 1e6, "k"), (1e6, 1e9, "M"), (1e9, float("inf"), "B")]
    want = {
        "fmt_bytes": {k: in_steps(float(v), size) for k, v in big.items()} | {None: None},
        "fmt_count": {k: str(v) if v < 1000 else in_steps(v, count) for k, v in big.items()} | {None: None},
    }
    for name, texts in want.items():
        rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.o_orderkey: r.text for r in rows} == texts and len(rows) == len(keys)
