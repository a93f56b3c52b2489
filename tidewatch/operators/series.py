"""The metric store: upsert, rollup, retention, range reads, export rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import number_text
from tidewatch.operators.rates import BYTE_METRICS

MINUTE_MS = 60_000

# Retention in milliseconds, plot size, named ranges in seconds.
RAW_RETENTION_MS = 6 * 3600 * 1000
ROLLUP_RETENTION_MS = 30 * 24 * 3600 * 1000
MAX_PLOT_POINTS = 2000
RANGES = {"15m": 900, "1h": 3600, "6h": 21_600, "24h": 86_400, "7d": 604_800}

SERIES_KEYS = ["server", "metric"]


def bucket_start(ts: Column, width: int) -> Column:
    """Start of the integer bucket holding ``ts``, in whole milliseconds."""
    return ts - ts % F.lit(width).cast("bigint")


def upsert_samples(samples: DataFrame, arrival: str = "seq") -> DataFrame:
    """One value per (server, metric, ts): the one that arrived last."""
    return samples.groupBy(*SERIES_KEYS, "ts").agg(F.max_by("value", arrival).alias("value"))


def rollup_1m(samples: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Minute averages with their extremes.

    With ``now_ms`` only minutes that ended at least 60 s ago are folded, so
    a minute is never folded from part of its samples.
    """
    if now_ms is not None:
        samples = samples.where(F.col("ts") < (now_ms - MINUTE_MS) // MINUTE_MS * MINUTE_MS)
    return samples.groupBy(*SERIES_KEYS, bucket_start(F.col("ts"), MINUTE_MS).alias("ts")).agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def apply_retention(
    samples: DataFrame, rollups: DataFrame, now_ms: int
) -> tuple[DataFrame, DataFrame]:
    """Raw rows of the last 6 hours and rollups of the last 30 days.

    Cut-offs sit on minute boundaries, so a fold never sees half a minute.
    """

    def cutoff(keep_ms: int) -> int:
        return (now_ms - keep_ms) // MINUTE_MS * MINUTE_MS

    return (
        samples.where(F.col("ts") >= cutoff(RAW_RETENTION_MS)),
        rollups.where(F.col("ts") >= cutoff(ROLLUP_RETENTION_MS)),
    )


@dataclass(frozen=True)
class RangeSpec:
    """What a time range reads: the table to start with and the bucket width."""

    from_ms: int
    to_ms: int

    @property
    def span_ms(self) -> int:
        return max(self.to_ms - self.from_ms, 1)

    @property
    def use_rollup(self) -> bool:
        return self.span_ms > RAW_RETENTION_MS

    @property
    def bucket_ms(self) -> int:
        return max(self.span_ms // MAX_PLOT_POINTS, 1)

    def clip(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("ts").between(self.from_ms, self.to_ms))

    @classmethod
    def last(cls, name: str, now_ms: int) -> RangeSpec:
        return cls(now_ms - RANGES[name] * 1000, now_ms)


def _bucketed(df: DataFrame, width: int, value: str, low: str, high: str) -> DataFrame:
    return df.groupBy(*SERIES_KEYS, bucket_start(F.col("ts"), width).alias("ts")).agg(
        F.avg(value).alias("value"), F.min(low).alias("min"), F.max(high).alias("max")
    )


def read_series(
    samples: DataFrame,
    rollups: DataFrame,
    from_ms: int,
    to_ms: int,
    servers: list[str] | None = None,
    metrics: list[str] | None = None,
) -> DataFrame:
    """Points of every series in ``[from_ms, to_ms]``, at most about 2000 each.

    Short ranges read raw samples. Long ones read rollups, and a series the
    rollups do not know falls back to raw samples on its own.
    """
    spec = RangeSpec(from_ms, to_ms)

    def source(df: DataFrame) -> DataFrame:
        df = spec.clip(df)
        if servers is not None:
            df = df.where(F.col("server").isin(servers))
        if metrics is not None:
            df = df.where(F.col("metric").isin(metrics))
        return df

    def points(df: DataFrame, *values: str, folded: bool) -> DataFrame:
        return _bucketed(df, spec.bucket_ms, *values).withColumn("downsampled", F.lit(folded))

    raw = source(samples)
    if not spec.use_rollup:
        return points(raw, "value", "value", "value", folded=False)
    long_range = source(rollups)
    # One row per series: raw rows of a known series are gone before they are bucketed.
    known = long_range.select(*SERIES_KEYS).distinct()
    unknown = raw.join(known, SERIES_KEYS, "left_anti")
    return points(long_range, "avg", "min", "max", folded=True).unionByName(
        points(unknown, "value", "value", "value", folded=False)
    )


def split_bytes_rates(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Byte rates and all other series, which need different axes."""
    is_bytes = F.col("metric").isin(BYTE_METRICS)
    return series.where(is_bytes), series.where(~is_bytes)


def stored_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """``stored_bytes``: the size of the data files under the folders, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    sizes = files.load(list(paths)).select("path", "length")
    return sizes.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))


def store_stats(samples: DataFrame, rollups: DataFrame, paths: Sequence[str] = ()) -> DataFrame:
    """Row counts of both tables, the oldest instant in either, and the bytes stored under ``paths``.

    Without ``paths`` the size is NULL: a table need not be files.
    """

    def side(df: DataFrame, raw: bool) -> DataFrame:
        n = F.count(F.lit(1))
        zero = F.lit(0).cast("bigint")
        return df.agg(
            (n if raw else zero).alias("raw_rows"),
            (zero if raw else n).alias("rollup_rows"),
            F.min("ts").alias("oldest_ms"),
            F.lit(None).cast("bigint").alias("stored_bytes"),
        )

    parts = side(samples, True).unionByName(side(rollups, False))
    if paths:
        parts = parts.unionByName(stored_bytes(samples.sparkSession, *paths), allowMissingColumns=True)
    return parts.agg(
        F.sum("raw_rows").alias("raw_rows"),
        F.sum("rollup_rows").alias("rollup_rows"),
        F.min("oldest_ms").alias("oldest_ms"),
        F.sum("stored_bytes").alias("stored_bytes"),
    )


def export_rows(samples: DataFrame, rollups: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Unbucketed values of a range, from the table that still holds them."""
    spec = RangeSpec(from_ms, to_ms)
    raw = spec.clip(samples).select(*SERIES_KEYS, "ts", "value")
    if not spec.use_rollup:
        return raw
    folded = spec.clip(rollups).select(*SERIES_KEYS, "ts", F.col("avg").alias("value"))
    known = folded.select(*SERIES_KEYS).distinct()
    return folded.unionByName(raw.join(known, SERIES_KEYS, "left_anti"))


def export_metrics_csv(
    samples: DataFrame, rollups: DataFrame, from_ms: int, to_ms: int
) -> DataFrame:
    """CSV lines with the columns they sort by; the header has a NULL ``ts``.

    Sorting by (metric, server, ts) puts the header first.
    """
    rows = export_rows(samples, rollups, from_ms, to_ms).select(
        "metric",
        "server",
        "ts",
        F.concat_ws(
            ",", F.col("ts").cast("string"), F.col("server"), F.col("metric"), number_text(F.col("value"))
        ).alias("line"),
    )
    header = samples.sparkSession.createDataFrame(
        [("", "", None, "timestamp_ms,server,metric,value")],
        "metric string, server string, ts bigint, line string",
    )
    return header.unionByName(rows)
