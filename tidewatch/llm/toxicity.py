"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of a lexicon (whole words and word beginnings), how often a
second person stands near such a word, shares of capitals, rates of punctuation and of
obfuscated spellings. The lexicon is learned from the labelled rows (words and beginnings that
mark toxic rows in any language) next to a short list of plain insults. Lexicon, trees and
calibration are fitted on a bounded sample of labelled rows; scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import crc_remainder, map_rows, texts
from tidewatch.llm.quality import labelled_sample

#: Labelled rows that are learned from, at most, and the longest of them in bytes.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16_000
#: Rows of label 1 that must hold a lexicon entry, and their least share of all rows that hold it.
LEAST_ROWS = 6
LEAST_SHARE = 0.9
LEXICON = 400
BEGINNINGS = (5, 6, 7, 8)
TREES = 60
DEPTH = 3
RATE = 0.15
BINS = 32
FOLDS = 3
#: Words between a second person and a lexicon word that count as near.
NEAR = 5

#: Plain insults, second persons and look-alike characters.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "ugly")
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta tú usted ustedes ti tus".encode().split())
_PLAIN = frozenset(w.encode() for w in INSULTS)
LOOKALIKES = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})

#: Bytes to words: ASCII that is no letter becomes a blank; all other characters are part of words.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MASKED = re.compile(r"[^\W\d_]+[@$!*013457][^\s.,;:]*[^\W\d_]")
#: What kind a byte is: 1 small letter or part of a longer character, 2 capital, 3 mark, 4 digit.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 4
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[128:] = 1
_MASKS = np.zeros(256, bool)
_MASKS[[ord(c) for c in "@$!*013457"]] = True

FEATURES = (
    "lexicon hits a hundred words", "lexicon hits", "share of distinct lexicon entries", "hits near a second person",
    "second persons a hundred words", "masked lexicon hits", "masked words a hundred words", "stretched words a hundred words",
    "share of capitals", "share of words in capitals", "exclamation marks a hundred characters", "question marks a hundred characters",
    "runs of punctuation a hundred words", "share of punctuation", "log of words", "plain insults", "plain insults a hundred words",
)


@dataclass
class Lexicon:
    words: frozenset[bytes]
    beginnings: frozenset[bytes]

    def __post_init__(self):
        self.heads = frozenset(w[:4] for w in self.words | self.beginnings)
        self.sizes = sorted({len(b) for b in self.beginnings})

    def entry(self, word: bytes) -> bytes | None:
        if word in self.words:
            return word
        return next((word[:n] for n in self.sizes if word[:n] in self.beginnings), None)


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """Words and word beginnings that stand in enough rows of label 1 and hardly in others."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in rows:
        words = {w.decode("utf-8", "replace") for w in split(text.lower())}
        seen[label].update(words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n})
    share = sum(label for _, label in rows) / max(1, len(rows))
    good = []
    for entry, n in seen[1].items():
        other = seen[0][entry]
        if n >= LEAST_ROWS and n / (n + other) >= LEAST_SHARE:
            good.append((-n * np.log(max(1e-9, (n / (n + other)) / max(share, 1e-9))), len(entry), entry))
    kept: list[str] = []
    for _, _, entry in sorted(good):
        bare = entry.rstrip("*")
        if len(kept) < LEXICON and not any(k.endswith("*") and bare.startswith(k[:-1]) for k in kept):
            kept.append(entry)
    whole = {*INSULTS, *(k for k in kept if not k.endswith("*"))}
    return Lexicon(
        frozenset(w.encode() for w in whole), frozenset(k[:-1].encode() for k in kept if k.endswith("*"))
    )


def split(lower: str) -> list[bytes]:
    """Words of a lower-cased text as UTF-8."""
    return lower.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def features(text: str, lexicon: Lexicon) -> list[float]:
    lower = text.lower()
    words = split(lower)
    hundred = max(1, len(words)) / 100
    heads = lexicon.heads
    hits = [(k, e) for k, w in enumerate(words) if w[:4] in heads and (e := lexicon.entry(w))]
    second = [k for k, w in enumerate(words) if w in SECOND]
    near = 0
    if hits and second:
        at = np.array(second)
        place = np.searchsorted(at, [k for k, _ in hits])
        for (k, _), p in zip(hits, place, strict=True):
            near += bool((p < len(at) and at[p] - k <= NEAR) or (p and k - at[p - 1] <= NEAR))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _KIND[raw]
    letter, mark, capital = (kind == 1) | (kind == 2), kind == 3, kind == 2
    masked = unmasked = stretched = runs = shouted = 0
    if raw.size > 2:
        if (letter[:-2] & _MASKS[raw[1:-1]] & (letter[2:] | _MASKS[raw[2:]])).any():
            found = _MASKED.findall(lower)
            masked = len(found)
            unmasked = sum(bool(lexicon.entry(m.translate(LOOKALIKES).replace("*", "").encode())) for m in found)
        same = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & letter[2:]
        stretched = int(same[0]) + int((same[1:] & ~same[:-1]).sum())
        runs = int(mark[0] & mark[1]) + int((mark[1:-1] & mark[2:] & ~mark[:-2]).sum())
        if (capital[:-2] & capital[1:-1] & capital[2:]).any():
            shouted = len(re.findall(r"\b[A-Z]{3,}\b", text))
    size = max(1, len(text))
    plain = sum(words[k] in _PLAIN for k, _ in hits)
    return [
        len(hits) / hundred, len(hits), len({e for _, e in hits}) / hundred, near,
        len(second) / hundred, unmasked, masked / hundred, stretched / hundred,
        int(capital.sum()) / max(1, int(letter.sum())), shouted / max(1, len(words)), 100 * text.count("!") / size,
        100 * text.count("?") / size, runs / hundred, int(mark.sum()) / size, float(np.log1p(len(words))),
        plain, plain / hundred,
    ]


# --- Trees -----------------------------------------------------------------------------------


@dataclass
class Boost:
    """``trees``: for each, split feature, split value and leaf value of a complete binary tree."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, value, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Boost:
    """Logistic gradient boosting with histogram splits."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boost(float(np.log(share / (1 - share))), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(x), model.start)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = _sigmoid(raw)
        g, h = y - p, p * (1 - p) + 1e-6
        feature, value = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            gain, best = 1e-6, None
            if own.size >= 8:
                total_g, total_h = g[own].sum(), h[own].sum()
                for f, e in enumerate(edges):
                    if not e.size:
                        continue
                    left_g = np.cumsum(np.bincount(bins[own, f], g[own], e.size + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins[own, f], h[own], e.size + 1))[:-1]
                    won = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    won[(left_h < 0.5) | (total_h - left_h < 0.5)] = 0
                    k = int(won.argmax())
                    if won[k] > gain:
                        gain, best = won[k], (f, e[k])
            if best:
                feature[at], value[at] = best
            node[own] = 2 * at + 1 + (x[own, feature[at]] > value[at])
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        values = RATE * sum_g / (sum_h + 1)
        model.trees.append((feature, value, values))
        raw += values[leaf]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, probability) of the monotone least-squares fit, by pooling neighbours.

    Rows of one raw score are one point of their mean label, whatever their order.
    """
    points, place, rows = np.unique(raw, return_inverse=True, return_counts=True)
    labels = np.bincount(place.ravel(), y, points.size)
    blocks: list[list[float]] = []
    for score, total, n in zip(points.tolist(), labels.tolist(), rows.tolist(), strict=True):
        blocks.append([total, n, score, score])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, high = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][3] = high
    knots = [(x, total / n) for total, n, low, high in blocks for x in ((low,) if low == high else (low, high))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boost
    knots: np.ndarray
    values: np.ndarray

    def scores(self, rows: list[str]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in rows]))
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Trees on all rows; the calibration on scores of rows that neither trees nor lexicon had seen."""
    rows = sorted(rows)
    labels = np.array([y for _, y in rows], np.float64)
    if not rows or labels.min() == labels.max():
        share = float(labels.mean()) if rows else 0.0
        return Model(Lexicon(frozenset(w.encode() for w in INSULTS), frozenset()), Boost(0.0, []), np.zeros(1), np.full(1, share))
    fold = np.random.default_rng(3).integers(0, FOLDS, len(rows))
    unseen = np.zeros(len(rows))
    for k in range(FOLDS):
        learned = [r for r, f in zip(rows, fold, strict=True) if f != k]
        if not learned or (fold == k).sum() == 0:
            continue
        lexicon = learn_lexicon(learned)
        x = np.array([features(t, lexicon) for t, _ in rows])
        unseen[fold == k] = boost(x[fold != k], labels[fold != k]).raw(x[fold == k])
    knots, values = isotonic(unseen, labels)
    lexicon = learn_lexicon(rows)
    trees = boost(np.array([features(t, lexicon) for t, _ in rows]), labels)
    return Model(lexicon, trees, knots, values)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample; rows whose crc32(doc_id) mod 5 is 0 are never learned from."""
    learned = crc_remainder("doc_id", 5) != 0
    return [(t.decode(), y) for t, y in labelled_sample(docs, labels, "toxic", learned, SAMPLE_ROWS, SAMPLE_BYTES)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier), one row per input row.

    Null texts count as empty and get the score of a text without words; repeated rows stay, a
    null doc_id stays null, an empty table gives an empty table, other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [x or "" for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "score": shared.value.scores(rows)}

    return map_rows(texts(docs), run, "doc_id long, score double")
