"""Removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash among the runs of
KEY words within it; consecutive windows mostly share one, and such a stretch (a super-k-mer)
travels as one packed string to the bucket of its minimiser, instead of as windows that repeat
every word WINDOW times. Equal windows have equal minimisers, so they meet in one bucket, where
they are sorted and compared by their words.

1. Minimisers alone are counted. One that starts in a single document only cannot hold a
   repeated window, and its stretches are never packed.
2. Stretches of the other minimisers are packed. Equal strings become one with the smallest
   doc_id (a map-side aggregate), so a passage in a third of all documents is a handful of rows.
3. Within a bucket the windows of all strings are sorted; equal neighbours give each window's owner, the
   smallest document that it starts in. A bucket of very many windows is split: its
   windows are keyed one by one by 128 bits of their words, aggregated map-side and joined back.
4. Owners go back by string to every occurrence, and words of windows owned by a smaller
   document are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import byte_texts, discard, map_rows, shared_folder, stored, texts, window_hashes, word_hashes

WINDOW = 50
KEY = 8
#: Windows of one bucket beyond which they are dealt out one by one; what one task holds is about
#: 400 bytes for each.
LARGE_BUCKET = 60_000
#: Windows of one packed string, at most.
LONGEST = 256


def stretches(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer, in order."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = window_hashes(word_hashes(words), KEY)
    least = _sliding_minimum(keys, WINDOW - KEY + 1)
    cut = np.r_[True, least[1:] != least[:-1]]
    first = np.flatnonzero(cut)
    # Periodic text has one minimiser for long: such a stretch is cut into pieces of bounded length.
    cut |= (np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))) % LONGEST == 0
    first = np.flatnonzero(cut)
    return least[first].view(np.int64), first, np.diff(np.r_[first, n])


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from minima of blocks forwards and backwards."""
    n = values.size - width + 1
    rows = -(-values.size // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: values.size] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def minimisers(docs: DataFrame) -> DataFrame:
    """doc_id and minimiser of each super-k-mer."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
            found = np.unique(stretches(text.split())[0])
            ids.append(np.full(found.size, doc, np.int64))
            keys.append(found)
        return {"doc_id": np.concatenate(ids), "minimiser": np.concatenate(keys)}

    return map_rows(docs, run, "doc_id long, minimiser long")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, windows, minimiser and words of the stretches whose minimiser ``wanted`` lists."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "text_hash", "first", "windows", "minimiser", "words")}
        rows = zip(
            *(batch.column(k).to_pylist() for k in ("doc_id", "text_hash", "wanted")), byte_texts(batch.column("text")), strict=True
        )
        for doc, text_hash, wanted, text in rows:
            words = text.split()
            keys, first, windows = stretches(words)
            for k in np.flatnonzero(np.isin(keys, wanted)).tolist():
                start, n = int(first[k]), int(windows[k])
                values = (doc, text_hash, start, n, int(keys[k]), b" ".join(words[start : start + n + WINDOW - 1]))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
        return out

    schema = "doc_id long, text_hash long, first long, windows long, minimiser long, words binary"
    return map_rows(docs, run, schema)


def window_texts(words: bytes) -> list[bytes]:
    """All windows of a packed string."""
    ends = [k for k, c in enumerate(words) if c == 0x20]
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(words))
    return [words[starts[k] : ends[k + WINDOW - 1]] for k in range(len(starts) - WINDOW + 1)]


def bucket_owners(rows: list[tuple[bytes, bytes, int]]) -> list[tuple[bytes, list[int]]]:
    """(string key, owner of each of its windows) of one bucket's (key, words, smallest doc_id)."""
    windows = sorted((w, doc, k, place) for k, (_, words, doc) in enumerate(rows) for place, w in enumerate(window_texts(words)))
    owners: list[dict[int, int]] = [{} for _ in rows]
    last, owner = None, 0
    for w, doc, k, place in windows:
        if w != last:
            last, owner = w, doc
        owners[k][place] = owner
    return [(key, [own[p] for p in range(len(own))]) for (key, _, _), own in zip(rows, owners, strict=True)]


def _settle(strings: DataFrame) -> DataFrame:
    """string_key and owners of the strings of ordinary buckets; a bucket is one group of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []

        def batch_of(found: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.binary()), pa.array([o for _, o in found], pa.list_(pa.int64()))],
                names=["string_key", "owners"],
            )

        for batch in batches:
            out = []
            for key, string, words, doc in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != bucket:
                    out += bucket_owners(rows)
                    bucket, rows = key, []
                rows.append((string, words, doc))
            yield batch_of(out)
        yield batch_of(bucket_owners(rows))

    dealt = strings.select("minimiser", "string_key", "words", "least").repartition("minimiser").sortWithinPartitions("minimiser")
    return dealt.mapInArrow(run, "string_key binary, owners array<long>")


def _settle_large(strings: DataFrame) -> DataFrame:
    """The same for buckets of any size: windows one by one, by 128 bits of their words."""

    def run(batch: pa.RecordBatch) -> dict:
        import xxhash

        out: dict = {k: [] for k in ("string_key", "least", "place", "window")}
        for string, words, doc in zip(*(batch.column(k).to_pylist() for k in ("string_key", "text", "least")), strict=True):
            for place, w in enumerate(window_texts(words)):
                for name, value in zip(out, (string, doc, place, xxhash.xxh3_128_digest(w)), strict=True):
                    out[name].append(value)
        return out

    rows = strings.select("string_key", F.col("words").alias("text"), "least")
    windows = map_rows(rows, run, "string_key binary, least long, place int, window binary")
    owners = windows.groupBy("window").agg(F.min("least").alias("owner"))
    found = windows.join(owners, "window").groupBy("string_key")
    places = F.array_sort(F.collect_list(F.struct("place", "owner")))  # at most the windows of one string
    return found.agg(F.transform(places, lambda x: x["owner"]).alias("owners"))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc_id, text and starts: first words of the windows that also start in a smaller document."""
    spark = docs.sparkSession
    folders = [shared_folder(spark) for _ in range(3)]
    rows = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = stored(minimisers(rows), folders[0])
    shared = found.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # A document's own minimisers: bounded by its length.
    wanted = found.join(shared.select("minimiser"), "minimiser").groupBy("doc_id").agg(F.collect_set("minimiser").alias("wanted"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    parts = packed(hashed.join(wanted, "doc_id").select("doc_id", "text_hash", "wanted", "text"))
    parts = stored(parts.withColumn("string_key", F.unhex(F.md5("words"))), folders[1])
    discard(spark, folders[0])
    strings = parts.groupBy("string_key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("minimiser").alias("minimiser"),
        F.first("windows").alias("windows"), F.first("words").alias("words"),
    )
    strings = stored(strings, folders[2])
    sizes = strings.groupBy("minimiser").agg(F.sum("windows").alias("held"), F.min("least").alias("low"), F.max("most").alias("high"))
    sized = strings.join(sizes.where("low < high"), "minimiser")
    owners = _settle(sized.where(F.col("held") <= LARGE_BUCKET)).unionAll(_settle_large(sized.where(F.col("held") > LARGE_BUCKET)))
    hits = (
        parts.select("doc_id", "text_hash", "first", "string_key")
        .join(owners, "string_key")
        .select("doc_id", "text_hash", "first", F.filter(F.transform("owners", lambda o, k: F.when(o < F.col("doc_id"), F.col("first") + k)), lambda x: x.isNotNull()).alias("starts"))
        .where(F.size("starts") > 0)
    )
    hits = hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("starts")).alias("starts"))
    own = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return own.join(hits, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")


def covered(n: int, starts: list[int]) -> np.ndarray:
    """Which of ``n`` words the windows that begin at ``starts`` cover."""
    change = np.zeros(n + 1, np.int64)
    begin = np.unique(np.array(starts, np.int64))
    change[begin] += 1
    change[begin + WINDOW] -= 1
    return np.cumsum(change)[:n] > 0


def kept_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space), one row per input row.

    Null and empty texts have no words and an empty ``kept``. Rows of a null doc_id have no order:
    nothing is removed from them and they own no window. Rows of one doc_id, also with different
    texts, are the same document: none removes words of another. Repeated rows stay; an empty
    table gives an empty table; other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_words", "n_removed", "kept")}
        for starts, text in zip(batch.column("starts").to_pylist(), byte_texts(batch.column("text")), strict=True):
            words = text.split()
            gone = covered(len(words), starts) if starts else np.zeros(len(words), bool)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if starts else words
            out["kept"].append(b" ".join(kept).decode())
        return {"doc_id": batch.column("doc_id")} | out

    return map_rows(repeated_starts(docs), run, "doc_id long, n_words long, n_removed long, kept string")
