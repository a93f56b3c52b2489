"""A store of samples in generations: a merge is seen as a whole or not at all.

``data/gen=N/server=S/day=D`` holds the rows of one (server, day) as generation N left them and is
never changed. ``manifest/gen=N`` is a table that says which generation each (server, day) is read from, and
``current`` is one small file with the number of the manifest that counts. A merge writes the touched
partitions and a manifest under a new number, and only then replaces ``current`` by a rename. A writer
that fails on the way leaves files that nobody reads; ``vacuum`` deletes them. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.timeline import DAY_MILLIS

STORE_SCHEMA = "server string, metric string, ts bigint, value double, seq bigint, day bigint"
MANIFEST_SCHEMA = "server string, day bigint, gen bigint"


def _files(spark: SparkSession, path: str):
    """Hadoop's path class and the file system of the store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def current_generation(spark: SparkSession, path: str) -> int:
    """The number that counts, 0 for a store without data."""
    make, fs = _files(spark, path)
    pointer = make(f"{path}/current")
    if not fs.exists(pointer):
        return 0
    stream = fs.open(pointer)
    try:
        return int(stream.readLine())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, generation: int) -> None:
    """Point readers to a generation, by writing a file aside and renaming it over the old one."""
    make, fs = _files(spark, path)
    aside = make(f"{path}/current.{generation}")
    stream = fs.create(aside, True)
    try:
        stream.writeBytes(f"{generation}\n")
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(make(f"{path}/current")), options)


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """server, day and the generation that holds them."""
    number = current_generation(spark, path) if generation is None else generation
    if not number:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest/gen={number}")


def _rows_of(spark: SparkSession, path: str, parts: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of the (server, day, gen) in ``parts``; only their generations are listed."""
    numbers = sorted(r.gen for r in parts.select("gen").distinct().collect())
    if not numbers:
        return spark.createDataFrame([], STORE_SCHEMA)
    rows = (
        spark.read.schema(f"{STORE_SCHEMA}, gen bigint")
        .option("basePath", f"{path}/data")
        .parquet(*[f"{path}/data/gen={n}" for n in numbers])
    )
    if first is not None:
        rows = rows.where(F.col("day").between(first, last))
    return rows.join(parts, ["server", "day", "gen"], "left_semi").select("server", "metric", "ts", "value", "seq", "day")


def read_store(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The store as of now, from one day to another if given. Later merges do not change what is read."""
    parts = manifest(spark, path)
    if first is not None:
        parts = parts.where(F.col("day").between(first, last))
    return _rows_of(spark, path, parts, first, last)


def merge_samples(batch: DataFrame, path: str) -> None:
    """Merge ``(server, metric, ts, value, seq)`` into the store, the last arrival of a key winning.

    Only the (server, day) partitions the batch touches are read and written anew, under a new
    generation. The arrival number is stored with each value, so a batch that runs twice leaves the same
    rows. Rows without ``ts`` or ``server`` are left out.
    """
    spark = batch.sparkSession
    incoming = batch.where("ts IS NOT NULL AND server IS NOT NULL").withColumn("day", F.expr(f"ts div {DAY_MILLIS}")).persist()
    try:
        first, last = incoming.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return
        now = current_generation(spark, path)
        new = now + 1
        listed = manifest(spark, path, now)
        touched = incoming.select("server", "day").distinct()
        old = listed.where(F.col("day").between(first, last)).join(touched, ["server", "day"], "left_semi")
        merged = incoming.select("server", "metric", "ts", "value", "seq", "day").unionByName(_rows_of(spark, path, old, first, last))
        newest = merged.groupBy("server", "metric", "ts", "day").agg(
            F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")
        )
        # Few files per partition; one that is far bigger than others is split.
        newest.hint("rebalance", "server", "day").write.mode("overwrite").partitionBy("server", "day").parquet(f"{path}/data/gen={new}")
        kept = listed.join(touched, ["server", "day"], "left_anti").unionByName(touched.withColumn("gen", F.lit(new).cast("long")))
        kept.write.mode("overwrite").parquet(f"{path}/manifest/gen={new}")
        _switch(spark, path, new)
    finally:
        incoming.unpersist()


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what the current manifest does not name, and how many folders that were.

    Run it when no reader of an older generation is at work. A generation of which one partition still counts is
    kept whole.
    """
    make, fs = _files(spark, path)
    now, gone = current_generation(spark, path), 0
    if not fs.exists(make(f"{path}/data")):
        return 0
    used = manifest(spark, path, now).select("gen").distinct()
    numbers = {r.gen for r in used.collect()}
    for kind, keep in (("data", numbers), ("manifest", {now})):
        for status in fs.listStatus(make(f"{path}/{kind}")):
            name = status.getPath().getName()
            if name.startswith("gen=") and int(name[4:]) not in keep:
                fs.delete(status.getPath(), True)
                gone += 1
    return gone
