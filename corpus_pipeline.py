"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language: documents whose language cannot be told (no text, no letters) go.
2. near_copies: of each group of linked documents one stays, that of the smallest doc_id, then of the
   smallest text hash; ids that are null come last.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret is replaced by a mark of its kind; no document goes.
5. tokens: texts that survive byte-level BPE unchanged are encoded; the result carries the ids.

Stages 1 to 4 return the columns of their input. Rows with null columns are kept as the stage's
operator defines; rows without text go in stage 1. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, decontaminate, jaccard, languages, secrets
from tidewatch.llm.common import byte_texts, shared_folder, slices, stored, table


def mapped(frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``function`` over slices of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield function(part)

    return frame.mapInArrow(run, schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document in a language that was learned; the model is learned from ``docs``.

    Where no row has a language to learn from, every document with a letter stays.
    """
    model = languages.fit(languages.training_rows(docs))
    shared = spark.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [x or "" for x in batch.column("text").to_pylist()]
        if not shared.value.languages:
            return batch.filter(pa.array([languages.has_letter(x) for x in rows], pa.bool_()))
        found = languages.decide(shared.value, rows)
        return batch.filter(pa.array([k != "und" for k, _ in found], pa.bool_()))

    return mapped(docs, keep, docs.schema)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the smallest (doc_id, text_hash), null ids last.

    Texts without words are in no class: each (doc_id, text) of theirs stays once.
    """
    alone = F.col("class").isNull()
    keys = ["class", F.when(alone, F.col("doc_id")).alias("own_id"), F.when(alone, F.col("text_hash")).alias("own_hash")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    kept = jaccard.numbered_classes(docs).groupBy(*keys).agg(least)
    kept = kept.select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_hash").alias("text_hash"))
    # A row travels as one value, so its columns may have any names.
    own = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    rows = own.join(kept, "text_hash").where(F.col("own_id").eqNullSafe(F.col("kept_id")))
    return rows.groupBy("own_id", "text_hash").agg(F.first("row").alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds an item of ``benchmark``."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    marked = found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    bad = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("row.text") == F.col("bad_hash"))
    return docs.select(F.struct(*docs.columns).alias("row")).join(marked, bad, "left_anti").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes ``[kind]`` in place of each secret (overlapping ones as one) and counts n_chars anew."""
    counted = "n_chars" in docs.columns

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = byte_texts(batch.column("text"))
        out = batch.column("text").to_pylist()
        sizes = batch.column("n_chars").to_pylist() if counted else []
        for k, spans in enumerate(secrets.scan_rows(rows)):
            if spans:
                out[k] = secrets.masked(out[k], spans)
                if counted:
                    sizes[k] = len(out[k])
        columns = {"text": out} | ({"n_chars": sizes} if counted else {})
        arrays = [
            pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in batch.schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return mapped(docs, mask, docs.schema)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and decoded_sha256; texts that do not decode to themselves fail."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoded_documents(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: Language and latent search cannot be written in SQL. The operators have their own brute-force tests; run() as a whole has none yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), shared_folder(spark))
    return docs
