"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark; passages are overlapping runs of words that cover every
   document. One pass over the table counts in how many passages each term stands and gathers a
   random sketch of the passages' term-by-term products (the range finder of a randomised
   singular value decomposition, summed over partitions).
2. The driver finishes the decomposition on matrices of benchmark size: directions that the
   corpus has in common are taken out, and the rest of the TF-IDF benchmark items gives the latent
   axes.
3. A second pass projects every passage and compares it with every item by cosine. Passages
   above the threshold are aligned with the item by longest common subsequence; a passage counts when
   enough of the item's words come in order, and, where an item names an answer, the answer too.
   Long items are compared by parts, but words and answer are always those of the whole item.

Each block of ``PARTS`` parts of items has axes of its own, so recall does not fall with the size of the
benchmark, and the driver's matrices have a fixed bound. ``BLOCKS`` of them share a pass over the table.

A passage is much longer than a short item, so its cosine says little. Items of ``SHORT`` words are also
found by their seldom words: an index of the heaviest words of each, such that every passage that holds
enough of the item's weight holds one of them. What it finds is aligned as above.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, slices, texts

#: Words of a passage, and of the step between passages.
PASSAGE = 64
STEP = 32
#: Columns of the sketch, common directions taken out, latent axes.
SKETCH = 20
COMMON = 12
AXES = 64
#: Parts of items in one block, blocks of one pass over the table, and the longest part of an item, in words, that a passage is compared with: a
#: passage holds half of such a part.
PARTS = 512
BLOCKS = 16
LONGEST = 128
COSINE = 0.45
COVERAGE = 0.6
#: Share of COVERAGE by which words of low weight may carry a match.
REACH = 0.7
#: Words of the items that the index of seldom words holds; of fewer words, 0.6 is no evidence by itself.
SHORT = range(6, 17)
#: Passages that are compared with the items at once.
ROWS = 4096

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII that is neither letter nor digit separates."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the answer that an item names after its last "answer:"; else none."""
    found = re.split(r"(?i)\banswer\s*:", text)
    return words_of(found[-1]) if len(found) > 1 else []


@dataclass
class Block:
    """Items as word lists, their answers, their parts with the item of each, and the number of each term."""

    ids: list[int]
    items: list[list[bytes]]
    answers: list[list[bytes]]
    parts: list[list[bytes]]
    owners: list[int]
    terms: dict[bytes, int]


def block_of(rows: list[tuple[int, list[bytes], list[bytes], list[bytes]]]) -> Block:
    """From (item_id, words, answer, part) rows; parts of one item follow each other."""
    block = Block([], [], [], [], [], {})
    for item, found, answer, part in rows:
        if not block.items or block.items[-1] is not found:
            block.ids.append(item)
            block.items.append(found)
            block.answers.append(answer)
        block.parts.append(part)
        block.owners.append(len(block.items) - 1)
    block.terms.update((w, k) for k, w in enumerate(sorted({w for part in block.parts for w in part})))
    return block


def item_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks; rows with a null id or text are left out, and so are items without words.

    An item beyond LONGEST words has several parts of equal length.
    """
    rows, kept = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().sort("item_id", "text"), []
    for row in rows.toLocalIterator():
        found, answer = words_of(row.text), answer_of(row.text)
        n = -(-len(found) // LONGEST)
        for k in range(n):
            kept.append((row.item_id, found, answer, found[len(found) * k // n : len(found) * (k + 1) // n]))
            if len(kept) == PARTS:
                yield block_of(kept)
                kept = []
    if kept:
        yield block_of(kept)


class _Numbers(dict):
    """Term numbers; -1 for all other words."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Terms:
    """The number of each term of several blocks, and by that number the one within each block, or -1."""

    numbers: _Numbers
    within: list[np.ndarray]

    def of_block(self, k: int, number: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.within[k][number]
        known = np.flatnonzero(own >= 0)
        return own[known], run[known]


def united(blocks: list[Block]) -> Terms:
    numbers = _Numbers((w, k) for k, w in enumerate(sorted(set().union(*(block.terms for block in blocks)))))
    within = []
    for block in blocks:
        own = np.full(len(numbers), -1, np.int32)
        own[[numbers[w] for w in block.terms]] = list(block.terms.values())
        within.append(own)
    return Terms(numbers, within)


def term_runs(found: list[list[bytes]], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, the STEP-word run of each, and the first run of each text (one more at the end)."""
    words = np.array([len(w) for w in found], np.int64)
    first = np.r_[0, np.cumsum(np.maximum(1, -(-words // STEP)))]
    number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int32, int(words.sum()))
    begin = np.cumsum(words) - words
    run = (np.arange(number.size) - np.repeat(begin, words)) // STEP + np.repeat(first[:-1], words)
    known = np.flatnonzero(number >= 0)
    return number[known], run[known], first


def run_sums(columns: np.ndarray, number: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
    """For each column (a row of ``columns``) the sums of its terms' values in each run; runs ascend."""
    out = np.zeros((len(columns), runs), np.float32)
    if run.size:
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        own = run[starts]
        for column, values in zip(out, columns, strict=True):
            column[own] = np.add.reduceat(values[number], starts)
    return out


def random_columns(block: Block) -> np.ndarray:
    """Random directions (rows); seldom terms of the benchmark weigh more, so that they are seen at all."""
    count = np.bincount([block.terms[w] for found in block.parts for w in set(found)], minlength=len(block.terms))
    weight = np.log1p(len(block.parts) / np.maximum(1, count))
    drawn = np.random.default_rng(17).normal(size=(len(block.terms), SKETCH))
    return np.ascontiguousarray((drawn * weight[:, None]).T, np.float32)


def gather(docs: DataFrame, blocks: list[Block], terms: Terms) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each block passages that hold each term, the sketch (terms by SKETCH), and the number of passages.

    Here passages are runs of STEP words; what reaches the driver has the size of the benchmark.
    """
    sizes = [len(block.terms) for block in blocks]
    shared = docs.sparkSession.sparkContext.broadcast((terms, [random_columns(block) for block in blocks]))
    names = ["block", "term", "held", *(f"y{k}" for k in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, columns = shared.value
        held, sketch, passages = [np.zeros(n, np.int64) for n in sizes], [np.zeros((n, SKETCH)) for n in sizes], 0
        for batch in batches:
            for part in slices(batch):
                found = [words_of(x or "") for x in part.column("text").to_pylist()]
                every, runs, first = term_runs(found, terms.numbers)
                passages += int(first[-1])
                for b, n in enumerate(sizes):
                    number, at = terms.of_block(b, every, runs)
                    if not number.size:
                        continue
                    once = np.unique(at * n + number) % n
                    held[b] += np.bincount(once, minlength=n)
                    product = run_sums(columns[b], number, at, int(first[-1]))
                    for k, values in enumerate(product):
                        sketch[b][:, k] += np.bincount(number, values[at], n)
        for b in range(len(sizes)):
            seen = np.flatnonzero(held[b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(seen.size + 1, b)), pa.array(np.r_[-1, seen]), pa.array(np.r_[passages, held[b][seen]])]
                + [pa.array(np.r_[0.0, sketch[b][seen, k]]) for k in range(SKETCH)],
                names=names,
            )

    schema = "block long, term long, held long, " + ", ".join(f"y{k} double" for k in range(SKETCH))
    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("block", "term")
    sums = sums.agg(F.sum("held").alias("held"), *(F.sum(f"y{k}").alias(f"y{k}") for k in range(SKETCH))).toArrow()
    owner, term, counts, *rows = (sums.column(k).to_numpy() for k in names)
    out = []
    for b, n in enumerate(sizes):
        held, sketch = np.zeros(n, np.int64), np.zeros((n, SKETCH))
        at = np.flatnonzero((owner == b) & (term >= 0))
        held[term[at]] = counts[at]
        for k, values in enumerate(rows):
            sketch[term[at], k] = values[at]
        out.append((held, sketch, int(counts[(owner == b) & (term < 0)].sum())))
    return out


@dataclass
class Latent:
    """``axes``: latent coordinates (rows) of the terms, inverse frequency included; ``parts``: unit rows;
    ``least``: how far a passage must reach in a part's direction to hold enough of its words."""

    axes: np.ndarray
    parts: np.ndarray
    least: np.ndarray


def randomised_axes(matrix: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Right singular vectors of the largest singular values, by a random range and power rounds."""
    rng = np.random.default_rng(23)
    width = min(rank + 16, *matrix.shape)
    q = np.linalg.qr(matrix.T @ rng.normal(size=(matrix.shape[0], width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(matrix.T @ (matrix @ q))[0]
    _, _, right = np.linalg.svd(matrix @ q, full_matrices=False)
    return (q @ right.T)[:, : min(rank, width)]


def inverse_frequency(held: np.ndarray, passages: int) -> np.ndarray:
    return np.log((1 + passages) / (1 + held)) + 0.1


def decompose(block: Block, held: np.ndarray, sketch: np.ndarray, passages: int) -> Latent:
    """Latent axes of the block's parts, free of what the corpus has in common."""
    inverse = inverse_frequency(held, passages)
    matrix = np.zeros((len(block.parts), len(block.terms)))
    for k, found in enumerate(block.parts):
        np.add.at(matrix[k], [block.terms[w] for w in found], 1.0)
    matrix *= inverse
    whole = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix /= whole
    left, size, _ = np.linalg.svd(sketch * inverse[:, None], full_matrices=False)
    common = left[:, :COMMON][:, size[:COMMON] > 1e-9 * max(1e-12, size.max(initial=0))]
    rest = matrix - (matrix @ common) @ common.T
    axes = randomised_axes(rest, AXES)
    places = rest @ axes
    norm = np.linalg.norm(places, axis=1, keepdims=True)
    parts = np.where(norm > 1e-9, places / np.maximum(norm, 1e-12), 0)
    # Of two passages that a part lies across, one holds three quarters of it or of a passage.
    part = np.minimum(1.0, 0.75 * PASSAGE / np.array([len(found) for found in block.parts]))
    least = REACH * COVERAGE * part * (whole * norm)[:, 0]
    return Latent(np.ascontiguousarray((axes * inverse[:, None]).T, np.float32), parts.astype(np.float32), least.astype(np.float32))


@dataclass
class Seldom:
    """Index of the SHORT items' heaviest words; terms are the numbers that all blocks share.

    ``first`` and ``postings``: rows of the tables below, by term. The tables hold, for each item, its
    distinct terms (-1 beyond the last), their share of its weight and how often each stands in it.
    """

    block: np.ndarray
    item: np.ndarray
    first: np.ndarray
    postings: np.ndarray
    terms: np.ndarray
    share: np.ndarray
    times: np.ndarray
    words: np.ndarray

    def candidates(self, number: np.ndarray, run: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, row of the tables) where the passage holds enough of the item's words and of their weight."""
        found, n = [np.zeros(0, np.int64)], np.int64(len(self.first) - 1)
        rows = np.int64(max(1, len(self.item)))
        if self.item.size and number.size:
            inner = ~np.isin(run, first[:-1])
            held = np.unique(np.r_[run * n + number, (run[inner] - 1) * n + number[inner]])
            for low in range(0, int(first[-1]), ROWS):
                part = held[slice(*np.searchsorted(held, (low * n, (low + ROWS) * n)))]
                passage, term = part // n, part % n
                size = self.first[term + 1] - self.first[term]
                at = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                pairs = np.unique(np.repeat(passage, size) * rows + self.postings[at])
                for start in range(0, pairs.size, ROWS * 16):
                    some = pairs[start : start + ROWS * 16]
                    row = some % rows
                    look = (some // rows)[:, None] * n + self.terms[row]
                    there = (part[np.minimum(np.searchsorted(part, look), part.size - 1)] == look) & (self.terms[row] >= 0)
                    weight, words = (there * self.share[row]).sum(axis=1), (there * self.times[row]).sum(axis=1)
                    found.append(some[(weight >= REACH * COVERAGE) & (words / self.words[row] >= COVERAGE)])
        every = np.concatenate(found)
        return every // rows, every % rows


def seldom_words(blocks: list[Block], terms: Terms, gathered: list[tuple[np.ndarray, np.ndarray, int]]) -> Seldom:
    own = [(b, k) for b, block in enumerate(blocks) for k, found in enumerate(block.items) if len(found) in SHORT]
    table = np.full((len(own), SHORT.stop - 1), -1, np.int64)
    share, times = np.zeros(table.shape), np.zeros(table.shape, np.int64)
    listed = []
    for row, (b, k) in enumerate(own):
        block, (held, _, passages) = blocks[b], gathered[b]
        count = Counter(block.items[k])
        weight = np.array(list(count.values())) * inverse_frequency(held[[block.terms[w] for w in count]], passages) ** 2
        order = np.argsort(-weight, kind="stable")
        number, size = np.array([terms.numbers[w] for w in count]), len(count)
        table[row, :size], times[row, :size] = number[order], np.array(list(count.values()))[order]
        share[row, :size] = weight[order] / weight.sum()
        # Words left out weigh too little together to be enough.
        taken = 1 + int(np.argmax(1 - np.cumsum(share[row, :size]) < REACH * COVERAGE - 1e-9))
        listed += [(int(t), row) for t in table[row, :taken]]
    listed.sort()
    term = np.array([t for t, _ in listed], np.int64)
    return Seldom(
        np.array([b for b, _ in own], np.int64),
        np.array([k for _, k in own], np.int64),
        np.searchsorted(term, np.arange(len(terms.numbers) + 1)),
        np.array([row for _, row in listed], np.int64),
        table,
        share,
        times,
        np.array([len(blocks[b].items[k]) for b, k in own], np.int64),
    )


def common_length(item: list[bytes], region: list[bytes]) -> int:
    """Longest common subsequence, the item's words as bits of one number."""
    places: dict[bytes, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def pace(item: list[bytes]) -> int:
    """Words between places where an item is judged: the passages of one place share one region."""
    return max(STEP, len(item) // 4 // STEP * STEP)


def judged(block: Block, k: int, words: list[bytes], start: int) -> tuple[float, int] | None:
    """(share of the item that comes in order, first word of the region) if it counts.

    ``start``: a multiple of the item's pace; the region serves all passages up to the next one.
    """
    item = block.items[k]
    low = max(0, start - len(item))
    region = words[low : start + pace(item) - STEP + PASSAGE + len(item)]
    held = set(region)
    if sum(w in held for w in item) / len(item) < COVERAGE:
        return None
    # Of the region, no stretch much longer than the item may be used.
    width, best = len(item) + len(item) // 2 + 2, (0.0, low)
    for at in range(0, max(1, len(region) - width + len(item) // 4 + 1), max(1, len(item) // 4)):
        best = max(best, (common_length(item, region[at : at + width]) / len(item), -(low + at)))
    coverage, at = best[0], -best[1] if best[0] else low
    if coverage < COVERAGE:
        return None
    answer = block.answers[k]
    if answer and common_length(answer, region) * 2 < len(answer):
        return None
    return coverage, at


def search(docs: DataFrame, blocks: list[Block], terms: Terms, latents: list[Latent], seldom: Seldom) -> DataFrame:
    """doc_id, text_hash, item_id, cosine, coverage and first_word of each passage that counts."""
    shared = docs.sparkSession.sparkContext.broadcast((blocks, terms, latents, seldom))

    def run(batch: pa.RecordBatch) -> dict:
        import xxhash

        blocks, terms, latents, seldom = shared.value
        out: dict = {k: [] for k in ("doc_id", "text_hash", "item_id", "cosine", "coverage", "first_word")}
        rows = batch.column("text").to_pylist()
        found = [words_of(x or "") for x in rows]
        every, runs, first = term_runs(found, terms.numbers)
        short_passage, short_row = seldom.candidates(every, runs, first)
        last = np.zeros(int(first[-1]), bool)
        last[first[1:] - 1] = True
        for b, (block, latent) in enumerate(zip(blocks, latents, strict=True)):
            number, at = terms.of_block(b, every, runs)
            sums = np.ascontiguousarray(run_sums(latent.axes, number, at, int(first[-1])).T)
            # A passage is a run and the next one of the same text.
            sums[:-1] += np.where(last[:-1, None], 0, sums[1:])
            norm = np.linalg.norm(sums, axis=1)
            near_passage, near_part = [], []
            for low in range(0, len(sums), ROWS):
                part, size = sums[low : low + ROWS], norm[low : low + ROWS]
                near = part @ latent.parts.T
                passage, column = np.nonzero((near >= COSINE * size[:, None]) & (near >= latent.least) & (size[:, None] > 1e-6))
                near_passage.append(passage + low)
                near_part.append(column)
            # A short item has one part.
            here = np.flatnonzero(seldom.block[short_row] == b)
            near_passage.append(short_passage[here])
            near_part.append(np.searchsorted(block.owners, seldom.item[short_row[here]]))
            passage, column = np.concatenate(near_passage), np.concatenate(near_part)
            owner = np.searchsorted(first, passage, side="right") - 1
            seen: set[tuple[int, int]] = set()
            tried: set[tuple[int, int, int]] = set()
            for p, c, own in zip(passage.tolist(), column.tolist(), owner.tolist(), strict=True):
                k = block.owners[c]
                start = (p - int(first[own])) * STEP
                start -= start % pace(block.items[k])
                if (own, k) in seen or (own, k, start) in tried:
                    continue
                tried.add((own, k, start))
                got = judged(block, k, found[own], start)
                if got:
                    seen.add((own, k))
                    values = (
                        batch.column("doc_id")[own].as_py(),
                        int(np.uint64(xxhash.xxh64_intdigest(rows[own].encode(), 42)).astype(np.int64)),
                        block.ids[k],
                        float(sums[p] @ latent.parts[c]) / max(1e-6, float(norm[p])),
                        *got,
                    )
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
        return out

    return map_rows(
        texts(docs), run, "doc_id long, text_hash long, item_id long, cosine double, coverage double, first_word long"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and benchmark item that it holds: the best passage's figures.

    Documents without a match give no row: null and empty texts, and all of them when the benchmark
    is empty. A null doc_id stays null; repeated rows of one text count once; an item_id that
    repeats with several texts is matched by any of them. Other columns are not carried.
    """
    parts = []
    blocks = item_blocks(benchmark)
    while some := list(islice(blocks, BLOCKS)):
        terms = united(some)
        gathered = gather(docs, some, terms)
        latents = [decompose(block, *own) for block, own in zip(some, gathered, strict=True)]
        parts.append(search(docs, some, terms, latents, seldom_words(some, terms, gathered)))
    if not parts:
        schema = "doc_id long, text_hash long, item_id long, coverage double, cosine double, first_word long"
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    best = F.max(F.struct("coverage", "cosine", "first_word")).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.*")
