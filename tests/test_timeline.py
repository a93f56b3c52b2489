"""Chunked look-backs against a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.timeline import chunk_of, look_back


def brute(rows):
    out, last, marks = {}, {}, {}
    for k, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        prev = last.get(k)
        out[(k, t)] = (prev, marks.get(k))
        if prev is None or (v is not None and prev[1] is not None and v > prev[1]):
            marks[k] = t
        last[k] = (t, v)
    return out


@pytest.mark.parametrize("width", [1.0, 7.0, 1e9])
def test_matches_a_plain_loop(spark, width):
    rng = random.Random(width)
    rows = [
        (rng.choice(["a", "a", "a", "b", None]), float(t), rng.choice([None, 1, 2, 3]))
        for t in rng.sample(range(300), 200)
    ]
    df = spark.createDataFrame(rows, "k string, t double, v int")
    rose = F.when(F.col("pt").isNull() | (F.col("v") > F.col("pv")), F.col("t"))
    got = look_back(
        df, ["k"], ["t"], chunk_of(F.col("t"), width),
        previous={"pt": F.col("t"), "pv": F.col("v")}, last_known={"mark": rose},
    ).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        prev, mark = want[(r.k, r.t)]
        assert (r.pt, r.pv) == (prev or (None, None)), r
        assert r.mark == mark, r


def test_a_busy_key_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("t"))
    out = look_back(df, ["k"], ["t"], chunk_of(F.col("t"), 500.0), previous={"pt": F.col("t")})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000
    assert out.where("pt <> t - 1").count() == 0
    assert out.where("pt IS NULL").count() == 1
