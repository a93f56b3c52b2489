"""Ranked lexical search over all documents by document FP-trees.

Documents keep only terms that some item asks for, seldom terms first, so each becomes a path; documents with
one beginning share it. Every tree covers a run of documents of one task and splits a path only while
more than ``LEAF`` documents share it. A node knows, for its whole subtree, the greatest tf of each term, the
smallest m and the smallest id. From these follows the most that any document below can score for an
item (a term that no document below holds adds nothing), and a depth-first search that opens
the best child first leaves out every subtree whose bound cannot enter the item's list. Lists are carried from tree to
tree of a task and merged over tasks.

Nothing is approximate: a subtree is left out only if its bound, with its smallest id, is behind the
last place of a full list.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import byte_texts, discard, map_rows, shared_folder, stored, texts

#: Documents that share a path of the tree without it being split further.
LEAF = 32
#: Documents and kept terms of one tree at most.
TREE_ROWS, TREE_TERMS = 25_000, 1_000_000
#: Items, and bytes of their texts, that are ranked in one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 8 << 20
#: Bytes of one text that are split into terms at a time.
SPLIT_BYTES = 4 << 20

#: A-Z become a-z; digits, a-z and all bytes of other characters stay; the rest parts terms.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_LAST = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text; long texts go in slices that end at a gap."""
    clean, counts, start = text.translate(_TERM_BYTES), Counter(), 0
    while start < len(clean):
        end = start + SPLIT_BYTES
        if end < len(clean):
            end = clean.find(b" ", end)
            end = len(clean) if end < 0 else end
        counts.update(clean[start:end].split())
        start = end
    return counts


def weight(documents: int, holding: int) -> int:
    """w of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def document_m(terms: int, documents: int, total: int) -> int:
    return 75 + 25 * terms * documents // total


def _restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the terms and tfs of the vocabulary, for every row."""

    def cut(batch: pa.RecordBatch) -> dict:
        sizes, terms, tfs = [], [], []
        for text in byte_texts(batch.column("text")):
            counts = term_counts(text)
            held = [(vocabulary[t], n) for t, n in counts.items() if t in vocabulary]
            sizes.append(counts.total())
            terms.append([t for t, _ in held])
            tfs.append([n for _, n in held])
        return {"doc_id": batch.column("doc_id"), "n": sizes, "terms": terms, "tfs": tfs}

    return map_rows(texts(docs), cut, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """An FP-tree over the restricted vectors of a run of documents.

    Terms are ranks, seldom terms first. ``ids`` holds doc_ids; rows without one have ``none`` set. The
    documents are sorted by their paths, so a node is a slice of them; a stretch of path without a fork is one edge.
    """

    def __init__(self, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray, none: np.ndarray):
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(sizes.size), sizes)
        inside = np.lexsort([ranks, owner])
        ranks, tfs = ranks[inside], tfs[inside]
        # Terms as big-endian numbers: paths compare as their bytes do.
        written, ends = ranks.astype(">u4").tobytes(), (4 * starts).tolist()
        paths = [written[a:b] for a, b in zip(ends, ends[1:])]
        order = np.array(sorted(range(sizes.size), key=paths.__getitem__), np.int64)
        self._grow([paths[k] for k in order.tolist()])
        del paths, written
        self.m, self.ids, self.none = m[order], ids[order], none[order]
        # Terms and tfs of all documents one after the other, in tree order.
        sizes = sizes[order]
        self.starts = np.append(0, np.cumsum(sizes))
        picked = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(ranks.size)
        self.terms, tfs = ranks[picked].astype(np.int32), tfs[picked]
        self.share = _share(tfs, np.repeat(self.m, sizes))
        self._summarise(tfs)

    def _grow(self, paths: list[bytes]) -> None:
        """Nodes as slices of the sorted documents; the children of a node are numbered in a row."""
        first, end, kids = [0], [len(paths)], []
        node = 0
        while node < len(first):
            a, b = first[node], end[node]
            begin = len(first)
            if b - a > LEAF and paths[b - 1] != paths[a]:
                d = _shared(paths[a], paths[b - 1])
                # Documents that end here come first and stay together.
                while a < b:
                    head = paths[a][d : d + 4]
                    c, top = a, b
                    while c < top:
                        mid = (c + top) // 2
                        if paths[mid][d : d + 4] == head:
                            c = mid + 1
                        else:
                            top = mid
                    first.append(a)
                    end.append(c)
                    a = c
            kids.append((begin, len(first)))
            node += 1
        self.first, self.end, self.kids = np.array(first), np.array(end), kids

    def _summarise(self, tfs: np.ndarray) -> None:
        """Of each subtree the smallest m and id, and its terms with the most that each can count there."""
        keyed = np.where(self.none, _LAST, self.ids)
        count = self.first.size
        self.least_m, self.least_id = np.zeros(count, np.int64), np.full(count, _LAST)
        held, parts = np.zeros(count, np.int64), []
        level = np.array([0])
        while level.size:
            first, end = self.first[level], self.end[level]
            if end[-1] > first[0]:
                # Slices of one level rise and do not overlap.
                self.least_m[level] = np.minimum.reduceat(np.append(self.m, _LAST), _edges(first, end))[::2]
                self.least_id[level] = np.minimum.reduceat(np.append(keyed, _LAST), _edges(first, end))[::2]
                spans = self.starts[end] - self.starts[first]
                at = np.repeat(self.starts[first] - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
                key = np.repeat(np.arange(level.size), spans) << 32 | self.terms[at]
                order = np.argsort(key, kind="stable")
                key = key[order]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.zeros(0, np.int64)
                most = np.maximum.reduceat(tfs[at][order], heads) if key.size else np.zeros(0, np.int64)
                spot, term = key[heads] >> 32, (key[heads] & 0xFFFFFFFF).astype(np.int32)
                held[level] = np.bincount(spot, minlength=level.size)
                parts.append((term, _share(most, self.least_m[level][spot])))
            level = np.concatenate([np.arange(*self.kids[k]) for k in level.tolist()]).astype(np.int64)
        # Levels are numbered one after the other, so the parts are in the order of the nodes.
        self.node_starts = np.append(0, np.cumsum(held))
        self.node_terms = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        self.node_share = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)

    def search(self, dear: np.ndarray, best: "Best") -> None:
        """Puts the documents that belong there into an item's list; ``dear`` is its weight for each rank."""
        stack = [(0, int(self._bounds(dear, 0, 1)[0]))]
        while stack:
            node, bound = stack.pop()
            if not best.open_to(bound, self.least_id[node]):
                continue
            begin, end = self.kids[node]
            if begin == end:
                self._score(dear, self.first[node], self.end[node], best)
                continue
            bounds = self._bounds(dear, begin, end)
            near = np.flatnonzero(bounds >= best.least())
            # The best child comes last, so it is opened first.
            for k in near[np.argsort(bounds[near], kind="stable")].tolist():
                stack.append((begin + k, int(bounds[k])))

    def _bounds(self, dear: np.ndarray, begin: int, end: int) -> np.ndarray:
        """The most that a document below each of the nodes ``begin``..``end`` can score."""
        return _sums(dear, self.node_terms, self.node_share, self.node_starts[begin : end + 1])

    def _score(self, dear: np.ndarray, first: int, end: int, best: "Best") -> None:
        scores = _sums(dear, self.terms, self.share, self.starts[first : end + 1])
        best.offer(scores, self.ids[first:end], self.none[first:end])


def _shared(a: bytes, b: bytes) -> int:
    """Bytes of the terms at which two paths begin alike."""
    d = 0
    while a[d : d + 4] == b[d : d + 4] and d < len(a):
        d += 4
    return d


def _edges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Borders for ``reduceat`` over slices that rise: every other result is a slice's own."""
    out = np.empty(2 * first.size, np.int64)
    out[::2], out[1::2] = first, end
    return out


def _sums(dear: np.ndarray, terms: np.ndarray, share: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weighted shares summed over each run of terms; an empty run has none."""
    a, b = starts[0], starts[-1]
    total = np.append(0, np.cumsum(dear[terms[a:b]] * share[a:b]))
    return total[starts[1:] - a] - total[starts[:-1] - a]


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score before its weight; grows with tf and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Best:
    """The ``size`` best documents of one item so far: highest score, then smallest id, null ids last."""

    def __init__(self, size: int):
        self.size = size
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Below this score nothing enters the list."""
        return int(self.scores[-1]) if self.scores.size >= self.size else 1

    def open_to(self, score: int, least_id: int) -> bool:
        if score <= 0 or self.scores.size < self.size:
            return score > 0
        last = _LAST if self.none[-1] else self.ids[-1]
        return score > self.scores[-1] or (score == self.scores[-1] and least_id <= last)

    def offer(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        keep = scores > 0
        if self.scores.size >= self.size:
            keep &= scores >= self.scores[-1]
        if not keep.any():
            return
        scores = np.concatenate([self.scores, scores[keep]])
        ids, none = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.none, none[keep]])
        order = np.lexsort([ids, none, -scores])[: self.size]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


def _trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, documents: int, total: int) -> Iterator[Tree]:
    """Trees over the rows of a task, each of a bounded number of rows and terms."""
    held: list[tuple] = []
    rows = terms = 0

    def tree() -> Tree:
        sizes = np.concatenate([h[0] for h in held])
        parts = [np.concatenate([h[k] for h in held]) for k in range(1, 6)]
        held.clear()
        return Tree(np.append(0, np.cumsum(sizes)), *parts)

    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            column = part.column("terms")
            sizes = np.diff(column.offsets.to_numpy())
            # Exact beyond 64 bits; an m that large only belongs to a score of nothing.
            m = np.array([min(document_m(n, documents, total), 1 << 56) for n in part.column("n").to_pylist()], np.int64)
            none = np.array(part.column("doc_id").is_null())
            ids = part.column("doc_id").fill_null(0).to_numpy()
            tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
            held.append((sizes, rank[column.flatten().to_numpy()], tf, m, ids, none))
            rows, terms = rows + part.num_rows, terms + tf.size
            if rows >= TREE_ROWS or terms >= TREE_TERMS:
                rows = terms = 0
                yield tree()
    if held:
        yield tree()


def _rank_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """The ranking of a bounded block of items."""
    spark = docs.sparkSession
    asked = [(item_id, term_counts((text or "").encode())) for item_id, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in asked for t in counts}))}
    folder = shared_folder(spark)
    vectors = stored(_restricted(docs, vocabulary), folder)
    seen = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    documents, total = seen[0], seen[1] or 0
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    holding = np.zeros(len(vocabulary), np.int64)
    for term, n in found:
        holding[term] = n
    weights = [weight(documents, int(n)) for n in holding]
    rank = np.empty(holding.size, np.int64)
    rank[np.lexsort([np.arange(holding.size), holding])] = np.arange(holding.size)
    queries = [
        (number, [(int(rank[vocabulary[t]]), weights[vocabulary[t]] * n) for t, n in counts.items() if holding[vocabulary[t]]])
        for number, (_, counts) in enumerate(asked)
    ]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(number, item, Best(k)) for number, item in queries if item]
        dear = np.zeros(rank.size, np.int64)
        for tree in _trees(batches, rank, documents, total):
            for _, item, best in lists:
                ranks = [r for r, _ in item]
                dear[ranks] = [w for _, w in item]
                tree.search(dear, best)
                dear[ranks] = 0
            del tree
        for number, _, best in lists:
            if best.scores.size:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(best.scores.size, number), pa.int64()),
                        pa.array(best.ids, pa.int64(), mask=best.none),
                        pa.array(best.scores, pa.int64()),
                    ],
                    names=["number", "doc_id", "score"],
                )

    near = vectors.where(F.size("terms") > 0).mapInArrow(search, "number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(asked)], "number long, item_id long")
    result = stored(ranked.join(names, "number").select("item_id", "rank", "doc_id", "score"))
    discard(spark, folder)
    return result


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Distinct (item_id, text) in blocks of bounded number and size; a longer text is a block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for row in rows.distinct().toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row.text or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text or "")
    if block:
        yield block


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest score above 0 for each item.

    Items are read in blocks of at most 2,000; each block is one pass over all documents. Null texts
    have no terms; items without a term that a document holds have no rows. Equal (item_id, text)
    count once; one item_id with several texts is ranked for each. Every row of ``docs`` is a
    document, repeated rows and null ids too; of equal scores null ids come last. Texts are taken whole, very
    long ones in slices that end between terms. Empty tables give an empty table; other columns are not read.
    """
    out = None
    for block in _blocks(benchmark):
        part = _rank_block(docs, block, k)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
