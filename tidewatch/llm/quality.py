"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded, a bank of learned filters slides over overlapping chunks that cover the
whole document, each filter's strongest response per chunk is pooled, and the largest, mean and
smallest of those over all chunks are combined by a logistic layer into one probability. The
smallest matters because a chunk of one word over and over excites few filters.

Filters and weights are fitted on a bounded sample of labelled rows; the gradient of a maximum
flows only to the place it came from, so a training step costs little more than scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import byte_texts, crc_remainder, map_rows, texts

#: Labelled rows that are learned from, at most, and the longest of them in bytes.
SAMPLE_ROWS = 1600
SAMPLE_BYTES = 16_000
CHUNK = 512
#: Bytes by which chunks overlap.
OVERLAP = 64
WIDTH = 8
STRIDE = 2
FILTERS = 24
EPOCHS = 14
#: Chunks that are convolved at once.
BLOCK = 256


def embedding() -> np.ndarray:
    """Eight fixed numbers for each byte: what kind it is, and four that tell bytes of a kind apart."""
    table = np.random.default_rng(11).normal(0, 0.5, (256, 8)).astype(np.float32)
    byte = np.arange(256)
    lower = (byte >= 97) & (byte <= 122) | (byte >= 128)
    upper = (byte >= 65) & (byte <= 90)
    digit = (byte >= 48) & (byte <= 57)
    blank = (byte == 32) | (byte >= 9) & (byte <= 13)
    for k, kind in enumerate((lower, upper, blank, ~(lower | upper | digit | blank))):
        table[:, k] = kind
    return table


_EMBEDDING = embedding()


@dataclass
class Network:
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    mean: np.ndarray
    scale: np.ndarray


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that together hold every byte; the last one is filled with blanks."""
    step = CHUNK - OVERLAP
    count = 1 + max(0, -(-(len(text) - CHUNK) // step))
    padded = np.full(step * (count - 1) + CHUNK, 32, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def windows(block: np.ndarray) -> np.ndarray:
    """[chunk, place, values]: what the filters see."""
    embedded = _EMBEDDING[block].reshape(len(block), -1)
    return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * 8, axis=1)[:, :: STRIDE * 8]


def responses(net: Network, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's strongest response in each chunk, and its place."""
    seen = windows(block)
    flat = seen.reshape(-1, WIDTH * 8) @ net.filters + net.bias
    flat = flat.reshape(len(block), -1, net.filters.shape[1])
    place = flat.argmax(axis=1)
    return np.maximum(0, np.take_along_axis(flat, place[:, None], axis=1)[:, 0]), place


def pooled(net: Network, rows: list[bytes]) -> np.ndarray:
    """Largest, mean and smallest response over each document's chunks."""
    out = np.zeros((len(rows), 3 * net.filters.shape[1]), np.float32)
    parts = [chunks(r) for r in rows]
    start = 0
    while start < len(rows):
        stop, held = start, 0
        while stop < len(rows) and (not held or held + len(parts[stop]) <= BLOCK):
            held += len(parts[stop])
            stop += 1
        # A document of many chunks is convolved block by block.
        joined = np.concatenate(parts[start:stop]) if stop - start > 1 else parts[start]
        top = np.concatenate([responses(net, joined[k : k + BLOCK])[0] for k in range(0, len(joined), BLOCK)])
        cuts = np.cumsum([0, *(len(p) for p in parts[start : stop - 1])])
        out[start:stop] = np.hstack(
            [np.maximum.reduceat(top, cuts), np.add.reduceat(top, cuts) / np.array([[len(p)] for p in parts[start:stop]]), np.minimum.reduceat(top, cuts)]
        )
        start = stop
    return out


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(net: Network, rows: list[bytes]) -> np.ndarray:
    values = (pooled(net, rows) - net.mean) / net.scale
    return _probability(values @ net.weights + net.offset).astype(np.float64)


def fit(rows: list[tuple[bytes, int]], seed: int = 5) -> Network:
    """A network of (text, label) pairs; without both labels every score is the label's share."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.25, (WIDTH * 8, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(3 * FILTERS, np.float32),
        0.0,
        np.zeros(3 * FILTERS, np.float32),
        np.ones(3 * FILTERS, np.float32),
    )
    labels = np.array([y for _, y in rows], np.float32)
    share = float(labels.mean()) if rows else 0.5
    if share in (0.0, 1.0) or not rows:
        net.offset = 30.0 * (2 * share - 1)
        return net
    rows = sorted(rows)
    labels = np.array([y for _, y in rows], np.float32)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    parts = [chunks(t) for t, _ in rows]
    start = pooled(net, [t for t, _ in rows])
    net.mean, net.scale = start.mean(axis=0), start.std(axis=0) + 0.1
    names = ("filters", "bias", "weights")
    moment = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (0.5 if epoch >= EPOCHS * 2 // 3 else 1.0)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            step += 1
            joined = np.concatenate([parts[k] for k in batch])
            got = [responses(net, joined[k : k + BLOCK]) for k in range(0, len(joined), BLOCK)]
            top, place = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            sizes = np.array([len(parts[k]) for k in batch])
            cuts = np.cumsum([0, *sizes[:-1]])
            high, low = np.maximum.reduceat(top, cuts), np.minimum.reduceat(top, cuts)
            value = (np.hstack([high, np.add.reduceat(top, cuts) / sizes[:, None], low]) - net.mean) / net.scale
            error = (_probability(value @ net.weights + net.offset) - labels[batch]) * weight[batch] / len(batch)
            back = error[:, None] * net.weights / net.scale
            own = np.repeat(np.arange(len(batch)), sizes)
            f = FILTERS
            flow = back[own, f : 2 * f] / sizes[own, None]
            flow = flow + back[own, :f] * (top == high[own]) + back[own, 2 * f :] * (top == low[own])
            flow *= top > 0
            embedded = _EMBEDDING[joined].reshape(len(joined), -1)
            grads = {"weights": value.T @ error + 1e-3 * net.weights, "bias": flow.sum(axis=0), "filters": np.zeros_like(net.filters)}
            for k in range(f):
                live = np.flatnonzero(flow[:, k])
                at_bytes = place[live, k, None] * (STRIDE * 8) + np.arange(WIDTH * 8)
                grads["filters"][:, k] = flow[live, k] @ embedded[live[:, None], at_bytes]
            net.offset -= rate * float(error.sum())
            for name in names:
                m, v = moment[name]
                m += 0.1 * (grads[name] - m)
                v += 0.01 * (grads[name] ** 2 - v)
                value_of = getattr(net, name)
                value_of -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """The bounded sample: texts of up to SAMPLE_BYTES with their label.

    Rows whose crc32(doc_id) mod 4 is 2 are never learned from, nor are null labels. Ids are dealt
    by hash into SAMPLE_ROWS draws, of which each gives the id with the smallest hash; a text that is
    drawn twice counts once.
    """
    return labelled_sample(docs, labels, "quality", crc_remainder("doc_id", 4) != 2, SAMPLE_ROWS, SAMPLE_BYTES)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learned, rows: int, longest: int) -> list[tuple[bytes, int]]:
    """(text, label) of a bounded number of labelled rows; shared by the two trained classifiers."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learned).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("hash")
    )
    draws = marked.groupBy(F.pmod("hash", F.lit(rows)).alias("draw")).agg(F.min("hash").alias("hash"))
    hashes = [r.hash for r in draws.select("hash").collect()]
    if not hashes:
        return []
    keys = F.broadcast(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    picked = {r.doc_id: r.label for r in marked.join(keys, "hash", "left_semi").groupBy("doc_id").agg(F.min("label").alias("label")).collect()}
    ids = F.broadcast(spark.createDataFrame([(k,) for k in picked], "doc_id long"))
    found = (
        texts(docs).where(F.octet_length("text") <= longest).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    )
    by_text: dict[bytes, int] = {}
    for r in sorted(found.collect(), key=lambda r: -r.doc_id):
        by_text[r.text.encode()] = picked[r.doc_id]
    return sorted(by_text.items())


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 likelier), one row per input row.

    Null texts count as empty and are scored like one blank chunk; repeated rows stay, a null
    doc_id stays null, an empty table gives an empty table, other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": scores(shared.value, byte_texts(batch.column("text")))}

    return map_rows(texts(docs), run, "doc_id long, score double")
