"""Byte-level BPE: a published rank file run by the tokenizers library over Arrow batches.

The rank file lists byte strings by merge rank. The library works on characters, so each byte
is written as one printable character (the byte table); a token's bytes are its characters
looked up backwards. Decoding goes through that table and never through text, so a character
that is split over several tokens comes back whole.

The vocabulary is fitted nowhere: it is read from the file that the caller names. It is one
file of bounded size (about 1 MB), read on the driver and sent with the task.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, texts

#: Distinct pieces whose ids a worker keeps; when full, the store is emptied and fills again.
KEPT_PIECES = 200_000

_loaded: dict[str, tuple] = {}


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = [""] * 256
    for byte in plain:
        table[byte] = chr(byte)
    spare = (byte for byte in range(256) if not table[byte])
    for offset, byte in enumerate(spare):
        table[byte] = chr(0x100 + offset)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string to rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def library_model(ranks: dict[bytes, int]) -> str:
    """The library's own JSON for the ranks.

    Ranks allow every pair whose joined bytes are a token, so each split of a token into two
    tokens is a merge, in the order of the joined token's rank. A piece that is a token as a
    whole needs no merging.
    """
    table = byte_characters()
    text = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [
        [text[token[:cut]], text[token[cut:]]]
        for token in sorted(ranks, key=ranks.__getitem__)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    vocab = {text[token]: rank for token, rank in ranks.items()}
    return json.dumps({"version": "1.0", "model": {"type": "BPE", "ignore_merges": True, "vocab": vocab, "merges": merges}})


class Codec:
    """One worker's tokenizer: pieces to ids by the library, ids to bytes by the byte table."""

    def __init__(self, model: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.find = regex.compile(pattern).findall
        self.tokenizer = Tokenizer.from_str(model)
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))
        back = {c: b for b, c in enumerate(characters)}
        vocab = json.loads(model)["model"]["vocab"]
        self.tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.kept: dict[str, bytes] = {}

    def learn(self, found: list[str]) -> None:
        """Ids of the pieces that are not kept yet, by one call of the library."""
        new = [p for p in dict.fromkeys(found) if p not in self.kept]
        if not new:
            return
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
            new = list(dict.fromkeys(found))
        written = [p.encode().decode("latin-1").translate(self.to_characters) for p in new]
        for piece, got in zip(new, self.tokenizer.encode_batch_fast(written, add_special_tokens=False), strict=True):
            self.kept[piece] = array("I", got.ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        found = self.find(text)
        try:
            parts = b"".join(map(self.kept.__getitem__, found))
        except KeyError:
            self.learn(found)
            parts = b"".join(map(self.kept.__getitem__, found))
        return np.frombuffer(parts, np.uint32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each id; a character split over ids belongs to all of them."""
        heads = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        before = np.concatenate([[0], np.cumsum(heads)])
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return before[np.minimum(starts + 1, heads.size)] - 1, before[ends]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def codec(model: str, pattern: str) -> Codec:
    """The worker's codec, built once for each vocabulary and pattern."""
    key = hashlib.sha256(f"{pattern}\0{model}".encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Codec(model, pattern)
    return _loaded[key]


def shared_model(spark: SparkSession, ranks_path: str):
    """The vocabulary as a broadcast: one file of bounded size, read on the driver."""
    return spark.sparkContext.broadcast(library_model(read_ranks(ranks_path)))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), starts and ends (characters of each id), one row per input row.

    Null and empty texts give empty arrays; a null doc_id stays null; repeated rows stay repeated;
    an empty table gives an empty table. Other columns are not carried.
    """
    model = shared_model(docs.sparkSession, ranks_path)

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(model.value, pattern)
        ids, starts, ends = [], [], []
        for text in batch.column("text").to_pylist():
            got = coder.ids(text or "")
            first, end = coder.spans(text or "", got)
            ids.append(got.astype(np.int32))
            starts.append(first)
            ends.append(end)
        return {"doc_id": batch.column("doc_id"), "ids": ids, "starts": starts, "ends": ends}

    return map_rows(texts(docs), run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of ``ids``; null ids decode to no bytes, an unknown id fails."""
    model = shared_model(tokens.sparkSession, ranks_path)

    def run(batches):
        coder = codec(model.value, pattern)
        for batch in batches:
            decoded = [coder.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and lossless, one row per input row.

    Encodes and decodes in one pass over the text, so that no array of ids is shuffled or stored.
    Edge cases as in ``encode``; the digest of no ids is that of no bytes.
    """
    model = shared_model(docs.sparkSession, ranks_path)

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(model.value, pattern)
        out: dict = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "lossless")}
        for text in batch.column("text").to_pylist():
            ids = coder.ids(text or "")
            decoded = coder.decode(ids.tolist())
            out["n_tokens"].append(ids.size)
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            out["lossless"].append(decoded == (text or "").encode())
        return {"doc_id": batch.column("doc_id")} | out

    return map_rows(
        texts(docs),
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean",
    )


def encoded_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decoded_sha256 of each document, for training.

    The ids are decoded again and must give the text's bytes; if not, the task fails. Null texts
    have no ids. Columns that ``docs`` lacks are null.
    """
    model = shared_model(docs.sparkSession, ranks_path)
    for name in ("lang", "source"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(model.value, pattern)
        out: dict = {k: [] for k in ("n_tokens", "ids", "decoded_sha256")}
        for text in batch.column("text").to_pylist():
            ids = coder.ids(text or "")
            decoded = coder.decode(ids.tolist())
            if decoded != (text or "").encode():
                raise ValueError("a text does not decode to itself")
            out["n_tokens"].append(ids.size)
            out["ids"].append(ids.astype(np.int32))
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return {k: batch.column(k) for k in ("doc_id", "lang", "source")} | out

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    return map_rows(
        rows, run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, decoded_sha256 string"
    )
