"""Streaming jobs run to the end of their input; their results are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.series import upsert_samples
from tidewatch.plans import queries_ops, queries_rates
from tidewatch.plans.registry import ORACLES, query
from tidewatch.plans.views import view, with_views
from tidewatch.plans.workspace import workspace
from tidewatch.sources.snapshots import read_status
from tidewatch.streaming import jobs
from tidewatch.streaming.store import merge_samples, read_store


def as_stream(df, home: str, *batches):
    """Land a table as files and read them back as a stream, one micro-batch for each part of ``batches``."""
    for k, part in enumerate(batches or (df,)):
        part.select(*df.columns).coalesce(1 if batches else 64).write.parquet(f"{home}/landing/{k:03d}")
    stream = df.sparkSession.readStream.schema(df.schema)
    if batches:
        stream = stream.option("maxFilesPerTrigger", 1)
    return stream.parquet(f"{home}/landing/*")


def finished(stream, home: str, folder: str = "out"):
    """Run to the end of the input and read what came out."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{home}/{folder}")
        .option("checkpointLocation", f"{home}/state-{folder}")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/{folder}")


def closing_mark(df, time: str, millis: int, **values):
    """One row ``millis`` after the newest of ``df``: the feed says that nothing older will come.

    It lets the watermark pass all rows; itself it stays open and gives no output.
    """
    newest = df.agg(F.max(time).alias("newest"))
    given = {**values, time: F.col("newest") + millis}
    return newest.select(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


@query(
    "stream_rates",
    queries_rates.NUMERIC
    + """, d AS (SELECT *, t - lag(t) OVER w AS dt, lag(value) OVER w AS prev FROM num WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY server, session, variable ORDER BY t))
    SELECT server, session, variable, t, wall_ms,
      CASE WHEN dt > 0 AND value >= prev THEN CAST(value - prev AS DOUBLE) / dt ELSE 0 END AS rate FROM d WHERE dt IS NOT NULL""",
)
def _(spark, sf):
    home = workspace(spark)
    rows = read_status(view(spark, sf, "status"))
    return finished(jobs.stream_rates(as_stream(rows, home)), home)


@query(
    "stream_rollup_1m",
    with_views("metrics")
    + """ SELECT server, metric, ts // 60000 * 60000 AS ts, avg(value) AS avg, min(value) AS min, max(value) AS max
    FROM v_metrics GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    """Every minute that the watermark closes, which are all: the mark itself stays open."""
    home = workspace(spark)
    rows = queries_rates.samples(spark, sf)
    mark = closing_mark(rows, "ts", 3_600_000, server=F.lit(""), metric=F.lit(""), value=F.lit(0.0))
    return finished(jobs.stream_rollup_1m(as_stream(rows, home, rows, mark)), home)


def shuffled_batches(rows, parts: int):
    """Rows in ``parts`` batches by time, every other counter one batch late; and how late that is in millis."""
    first, last = rows.agg(F.min("wall_ms"), F.max("wall_ms")).first()
    if first is None:
        return [rows], 0
    width = (last - first) // parts + 1
    late = F.crc32(F.col("variable").cast("binary")) % 2
    number = F.floor((F.col("wall_ms") - first) / width) + late
    placed = rows.withColumn("_batch", number)
    return [placed.where(F.col("_batch") == k).drop("_batch") for k in range(parts + 1)], 2 * width


@query("stream_derive_metrics", ORACLES["derive_metrics"])
def _(spark, sf):
    """Counters of one sample arrive in two batches; every sample is closed by the mark at the end."""
    home = workspace(spark)
    rows = read_status(view(spark, sf, "status"))
    batches, delay = shuffled_batches(rows, 4)
    mark = closing_mark(rows, "wall_ms", 2 * delay + 1, variable=F.lit("Queries"), server=F.lit(""), session=F.lit(""))
    samples = finished(jobs.stream_samples(as_stream(rows, home, *batches, mark), f"{delay} milliseconds"), home, "samples")
    feed = spark.readStream.schema(samples.schema).parquet(f"{home}/samples")
    return finished(jobs.stream_derive_metrics(feed, queries_rates.limits(spark, sf)), home)


@query("stream_alerts", ORACLES["alert_transitions"])
def _(spark, sf):
    home = workspace(spark)
    rows = queries_ops.alert_metrics(spark, sf)
    return finished(jobs.stream_alerts(as_stream(rows, home), queries_ops.RULES), home)


@query("stream_upsert", ORACLES["upsert_samples"])
def _(spark, sf):
    home = workspace(spark)
    minute = F.col("ts") - F.col("ts") % 60000
    rows = queries_rates.samples(spark, sf).withColumn("ts", minute)
    jobs.stream_upsert(as_stream(rows, home), f"{home}/store", f"{home}/state").awaitTermination()
    return read_store(spark, f"{home}/store").drop("seq", "day")


@query(
    "refold",
    with_views("metrics")
    + """ SELECT server, metric, ts // 60000 * 60000 AS ts, avg(value) AS avg, min(value) AS min, max(value) AS max
    FROM v_metrics GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    from tidewatch.operators.series import rollup_1m

    rows = queries_rates.samples(spark, sf)
    early = rollup_1m(rows.where("seq % 3 <> 0"))
    # Minutes that gained late samples are folded again from all their samples.
    late = rows.where("seq % 3 = 0").select("server", "metric", minute_of("ts").alias("minute")).distinct()
    touched = rows.withColumn("minute", minute_of("ts")).join(late, ["server", "metric", "minute"], "left_semi")
    return jobs.refold(early, touched.drop("minute"))


def minute_of(name: str):
    return F.col(name) - F.col(name) % 60000


@query("upsert_replay", ORACLES["upsert_samples"])
def _(spark, sf):
    """The same batches merged twice and out of order: the store is the same."""
    home = workspace(spark)
    rows = queries_rates.samples(spark, sf).withColumn("ts", minute_of("ts"))
    newer, older = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    for batch in (newer, older, newer):
        merge_samples(batch, f"{home}/store")
    return upsert_samples(read_store(spark, f"{home}/store"))
