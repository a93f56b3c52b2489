"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that mapping functions hold of one column at a time, as far as single rows allow it.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that further columns never reach Python."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer row comes alone."""
    sizes = batch.column(column).nbytes
    if sizes <= limit or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(lengths):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    yield batch.slice(start)


def map_rows(frame: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``function`` turns a slice of rows into columns (lists or arrays) of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = function(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                )

    return frame.mapInArrow(run, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidewatch-")
    return f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"


def stored(frame: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: lineage ends here."""
    spark = frame.sparkSession
    folder = folder or shared_folder(spark)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate table of ``stored``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_remainder(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def fmix(values: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; needs at least ``width`` words."""
    n = hashes.size - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = fmix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out
