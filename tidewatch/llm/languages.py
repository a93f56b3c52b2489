"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built; it accepts
exactly the substrings of the sample. A text is parsed against it greedily: each phrase is the
longest match from where the last one ended. The better a language models the text, the longer
its phrases, so the language whose parse needs the fewest phrases, normalised by the length,
wins.

Texts are written in a small alphabet (the commonest letters of the samples, one symbol for all
other letters, one for everything between words) so that the symbols that lead on from a state
are the bits of one word and many stretches of text step through the automaton at once. A text is
parsed in stretches of ``STRETCH`` symbols that together cover all of it.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_remainder, map_rows

#: Labelled documents of each language that are learned from, at most; one for each draw.
SAMPLE_ROWS = 48
#: Characters of each such document that are learned from, at most; a fit on a bounded sample.
SAMPLE_CHARS = 2500
#: Letters with a symbol of their own.
LETTERS = 61
STRETCH = 192
#: Stretches that step at once.
LANES = 16384


@dataclass
class Automaton:
    """Transitions without gaps: from a state by the symbols whose bits are set in ``held``, and the targets of
    those, in the order of the symbols, from ``first`` on. Some 12 bytes for each state and 4 for each transition;
    a dense table takes 4 for each state and symbol.
    """

    held: np.ndarray
    first: np.ndarray
    targets: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where each state goes by its symbol; -1 where nowhere."""
        held, bit = self.held.take(states), np.uint64(1) << symbols.astype(np.uint64)
        # Where the symbol is not held this may be one past the last target, so a spare one stands there.
        to = self.targets.take(self.first.take(states) + np.bitwise_count(held & (bit - np.uint64(1))))
        return np.where(held & bit, to, np.int32(-1))


def automaton(states: int, width: int, places: np.ndarray, targets: np.ndarray) -> Automaton:
    """Of transitions at places state * width + symbol; up to 64 symbols."""
    if width > 64:
        raise ValueError("a state's symbols must fit in 64 bits")
    order = np.argsort(places)
    state, symbol = np.divmod(places[order], width)
    held = np.zeros(states, np.uint64)
    np.bitwise_or.at(held, state, np.uint64(1) << symbol.astype(np.uint64))
    first = np.searchsorted(state, np.arange(states)).astype(np.int32)
    return Automaton(held, first, np.append(targets[order], -1).astype(np.int32))


@dataclass
class Model:
    """symbols: code point to symbol (0: between words, 1: other letter); automata: one for each language.

    A worker holds the automata as they are sent, a few bytes for each character of the sample.
    """

    languages: list[str]
    symbols: np.ndarray
    automata: list[Automaton]


def suffix_automaton(text: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(states, places, targets) of the automaton of all substrings: from state s by symbol c, at
    place s * width + c, to a target; state 0 starts."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text.tolist():
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        walk = last
        while walk >= 0 and symbol not in nexts[walk]:
            nexts[walk][symbol] = state
            walk = link[walk]
        if walk >= 0:
            target = nexts[walk][symbol]
            if length[walk] + 1 == length[target]:
                link[state] = target
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[target]))
                link.append(link[target])
                length.append(length[walk] + 1)
                while walk >= 0 and nexts[walk].get(symbol) == target:
                    nexts[walk][symbol] = copy
                    walk = link[walk]
                link[target] = link[state] = copy
        last = state
    places = np.array([state * width + symbol for state, row in enumerate(nexts) for symbol in row], np.int64)
    targets = np.array([target for row in nexts for target in row.values()], np.int32)
    return len(nexts), places, targets


def _lowered(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters() -> np.ndarray:
    """Which code points are letters or the marks on them."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def encoded(text: str, symbols: np.ndarray) -> np.ndarray:
    """Symbols of the text; runs without a letter become one 0."""
    out = symbols[_lowered(text)]
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    return out[keep]


def has_letter(text: str) -> bool:
    """Whether the text has a letter; a mark by itself is none."""
    return any(map(str.isalpha, text))


def fit(labelled: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs."""
    letters = _letters()
    counts = np.zeros(0x110000, np.int64)
    for _, text in labelled:
        points, n = np.unique(_lowered(text), return_counts=True)
        counts[points] += n
    counts[~letters] = 0
    symbols = letters.astype(np.uint8)
    # The commonest letters, ties to the smaller code point.
    common = np.lexsort((np.arange(counts.size), -counts))[:LETTERS]
    common = common[counts[common] > 0]
    symbols[common] = np.arange(2, 2 + common.size)
    languages = sorted({language for language, _ in labelled})
    width, automata = 2 + LETTERS, []
    for language in languages:
        parts = [encoded(t, symbols) for k, t in sorted(labelled) if k == language]
        states, places, targets = suffix_automaton(np.concatenate(parts), width)
        automata.append(automaton(states, width, places, targets))
    return Model(languages, symbols, automata)


def phrases(table: Automaton | np.ndarray, stretches: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Greedy phrases of each row of ``stretches``; the first ``lengths`` symbols count.

    The automaton may also come as a dense table, a row of targets for each state, -1 where there is none.
    """
    if isinstance(table, np.ndarray):
        places = np.flatnonzero(table >= 0)
        table = automaton(*table.shape, places, table.ravel()[places])
    root = table.step(np.zeros(64, np.int32), np.arange(64))
    count = np.zeros(len(stretches), np.int64)
    state = np.zeros(len(stretches), np.int32)
    order = np.argsort(-lengths, kind="stable")
    rows, alive = stretches[order], np.searchsorted(-lengths[order], -np.arange(1, stretches.shape[1] + 1), side="right")
    for step in range(stretches.shape[1]):
        n = int(alive[step])
        if not n:
            break
        symbol = rows[:n, step]
        to = table.step(state[:n], symbol)
        missed = to < 0
        fresh = root[symbol]
        # In the start state no phrase is open: at the beginning, and after a symbol that the sample lacks, which is one by itself.
        count[:n] += missed | (state[:n] == 0)
        state[:n] = np.where(missed, np.maximum(fresh, 0), to)
    out = np.empty_like(count)
    out[order] = count
    return out


def rates(model: Model, coded: list[np.ndarray]) -> np.ndarray:
    """Phrases a symbol, for each text and language; texts are cut into stretches."""
    total = np.zeros((len(coded), len(model.languages)))
    lengths, owners, cuts = [], [], []
    for owner, text in enumerate(coded):
        for start in range(0, text.size, STRETCH):
            part = text[start : start + STRETCH]
            cuts.append(part)
            lengths.append(part.size)
            owners.append(owner)
    for at in range(0, len(cuts), LANES):
        part = cuts[at : at + LANES]
        block = np.zeros((len(part), STRETCH), np.uint8)
        for row, x in zip(block, part, strict=True):
            row[: x.size] = x
        own, sizes = np.array(owners[at : at + LANES]), np.array(lengths[at : at + LANES])
        for k, language in enumerate(model.automata):
            np.add.at(total[:, k], own, phrases(language, block, sizes))
    return total / np.maximum(1, [[x.size] for x in coded])


def decide(model: Model, texts: list[str]) -> list[tuple[str, float]]:
    """(language, score) of each text; ("und", 0.0) without letters or without a learned language.

    Of languages that need equally few phrases the first by name is given; n of them share the score, 1 / n at most.
    """
    judged = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
    coded = {k: encoded(texts[k], model.symbols) for k in judged}
    out = [("und", 0.0)] * len(texts)
    if judged:
        got = rates(model, [coded[k] for k in judged])
        for k, row in zip(judged, got, strict=True):
            # Shares by the inverse rate, sharpened: near 1 for a clear winner, 1 / n for a draw.
            best = int(np.argmin(row))
            with np.errstate(under="ignore"):
                weight = np.exp(12 * (1 - row / max(row[best], 1e-9)))
            out[k] = (model.languages[best], float(weight[best] / weight.sum()))
    return out


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: up to SAMPLE_ROWS stretches of SAMPLE_CHARS characters per language.

    Rows whose crc32(doc_id) mod 3 is 1 are never learned from. Texts are dealt by hash into
    SAMPLE_ROWS draws per language and the smallest hash of each draw is taken, so copies of one
    text count once and neither order nor partitioning matters. A longer text gives the stretch
    that begins at a place drawn by its hash.
    """
    spark = docs.sparkSession
    rows = docs.where((crc_remainder("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("hash")
    )
    drawn = rows.groupBy("lang", F.pmod("hash", F.lit(SAMPLE_ROWS)).alias("draw")).agg(F.min("hash").alias("hash"))
    drawn = [(r.lang, r.hash) for r in drawn.select("lang", "hash").collect()]
    if not drawn:
        return []
    keys = F.broadcast(spark.createDataFrame(drawn, "lang string, hash long"))
    spare = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)
    part = F.substring(F.col("text"), (F.lit(1) + F.pmod(F.col("hash"), spare)).cast("int"), F.lit(SAMPLE_CHARS))
    found = rows.join(keys, ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.min(part).alias("part"))
    return [(r.lang, r.part) for r in found.select("lang", "part").collect()]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each text.

    One row per input row, so repeated rows are predicted alike and null ids stay; an empty table gives an empty
    table, and other columns are not read. ``und`` with score 0 for null texts and texts without letters, and for
    all when nothing could be learned. Texts of any length are parsed whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        got = decide(shared.value, [x or "" for x in batch.column("text").to_pylist()])
        return {
            "doc_id": batch.column("doc_id"),
            "lang_pred": [k for k, _ in got],
            "score": [min(1.0, max(0.0, s)) if math.isfinite(s) else 0.0 for _, s in got],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, run, "doc_id long, lang_pred string, score double")
