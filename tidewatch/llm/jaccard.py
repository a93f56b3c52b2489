"""Exact n-gram Jaccard join by prefix trees, and the classes of linked documents.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Sets are written in one global order, seldom shingles first (by a fixed-size count of the
shingles that stand out in some part of the table, ties by hash). Linked sets must share one of
their first n - ceil(0.8 n) + 1 shingles, so only those prefixes are indexed.

1. Equal sets become one set, so copies cost one row each and are never paired. Of the posting
   lists that hold the same sets only the earliest stays: it holds the first shingle that any two share.
2. Hub candidates: in each posting list every set is paired with a few hubs only.
3. Verification: pairs whose bitmaps show that they share too little go. The candidates left of a
   probe, in blocks, are stored in a prefix tree; the probe walks it once, sharing partial overlaps
   along common beginnings and leaving subtrees whose remaining length cannot reach the bound.
4. Links give components. The posting lists that still hold several components are settled by a
   forest: a list's sets are dealt by their paths behind its shingle (the prefix and a few more),
   common beginnings are stored once, and every set walks the trees of the shorter ones. A subtree
   is left as soon as the shared shingles that it can still reach are too few, or all of it lies
   in the walker's own component. Long lists are cut into blocks that meet block by block. What the
   walk finds is verified as before. Nothing is capped.

Only texts of candidate sets travel, never token sets of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import (
    byte_texts,
    discard,
    map_rows,
    shared_folder,
    slices,
    stored,
    texts,
    window_hashes,
    word_hashes,
)
from tidewatch.llm.components import components

WORDS = 5
#: Slots of the count of frequent shingles; its size is fixed, only the order depends on it.
SLOTS = 1 << 20
#: Hubs of a posting list.
HUBS = 8
#: Sets of a posting list that one forest holds; longer lists are cut into blocks.
CELL = 4096
#: Shingles behind its prefix that a set's path also holds; linked sets share that many more.
MORE = 32
#: Shingles behind the list's own that a row carries; those beyond count as shared.
REST = 512
#: Slots of a walker's path; shingles of one slot pass for each other until verification.
PLACES = 2048
#: Steps of a walk that are held at once, about.
STEPS = 1 << 18
#: Shingles of the paths in one forest, about; a cell stays whole.
HELD = 1 << 19
#: Members of one prefix tree.
BLOCK = 128

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit shingles; a shorter text is one shingle, a text without words none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < WORDS:
        return window_hashes(hashes, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(hashes, WORDS))


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def needed(a: int, b: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-4 * (a + b) // 9)


def ordered(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The set in global order."""
    return shingles[np.lexsort((shingles, weights[shingles & np.uint64(SLOTS - 1)]))]


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, in four to eight times as many slots as there are shingles, a power of two."""
    slots = np.zeros(1 << (int(shingles.size).bit_length() + 2), bool)
    slots[(shingles >> np.uint64(20)) & np.uint64(slots.size - 1)] = True
    return np.packbits(slots, bitorder="little").tobytes()


def most_shared(a: int, left: np.ndarray, b: int, right: np.ndarray) -> int:
    """Most shingles that sets of these sizes and bitmaps can share: a bit of one side only is a shingle of it alone."""
    size = min(left.size, right.size)
    left, right = (np.bitwise_or.reduce(x.reshape(-1, size)) if x.size > size else x for x in (left, right))
    both = int(np.bitwise_count(left & right).sum())
    return both + min(a - int(np.bitwise_count(left).sum()), b - int(np.bitwise_count(right).sum()))


class PrefixTree:
    """Sets in global order, common beginnings stored once."""

    def __init__(self):
        self.root = _Node(np.zeros(0, np.uint64))

    def add(self, tokens: np.ndarray, member: int) -> None:
        node, rest, size = self.root, tokens, tokens.size
        node.cover(size)
        while rest.size:
            child = node.children.get(int(rest[0]))
            if child is None:
                leaf = _Node(rest)
                leaf.cover(size)
                node.children[int(rest[0])] = leaf
                leaf.members.append((member, size))
                return
            n = min(rest.size, child.tokens.size)
            differ = np.flatnonzero(rest[:n] != child.tokens[:n])
            common = int(differ[0]) if differ.size else n
            if common < child.tokens.size:
                upper = _Node(child.tokens[:common])
                upper.least, upper.most = child.least, child.most
                node.children[int(rest[0])] = upper
                child.tokens = child.tokens[common:]
                upper.children[int(child.tokens[0])] = child
                child = upper
            child.cover(size)
            node, rest = child, rest[common:]
        node.members.append((member, size))

    def linked(self, probe: np.ndarray) -> list[int]:
        """Members whose similarity with the probe's sorted set is 0.8 or more."""
        found, stack = [], [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node.tokens.size:
                at = np.searchsorted(probe, node.tokens)
                overlap += int((probe[np.minimum(at, probe.size - 1)] == node.tokens).sum())
                depth += node.tokens.size
            if overlap + min(probe.size - overlap, node.most - depth) < needed(probe.size, node.least):
                continue
            found += [m for m, size in node.members if 9 * overlap >= 4 * (probe.size + size)]
            stack += [(child, depth, overlap) for child in node.children.values()]
        return found


class _Node:
    __slots__ = ("children", "least", "members", "most", "tokens")

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.children, self.members = tokens, {}, []
        self.least, self.most = 1 << 62, 0

    def cover(self, size: int) -> None:
        self.least, self.most = min(self.least, size), max(self.most, size)


# --- Passes over the table ---------------------------------------------------------------------


def frequent(docs: DataFrame) -> np.ndarray:
    """Weight of each slot: the logarithm of its count where it stands out in some partition, else 0.

    The result has SLOTS bytes whatever the table's size. Any order gives the same links; this one
    keeps common passages out of the prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in byte_texts(part.column("text")):
                    # Shingles of one set are distinct; so are its slots but for chance.
                    counts[shingle_set(text) & np.uint64(SLOTS - 1)] += 1
        slot = np.flatnonzero(counts >= max(8, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # One job, whatever the number of partitions; five bytes for each slot. The binary form of n is as long as its weight less one.
    found = found.select(F.col("slot").cast("int"), (F.length(F.bin("n")) + 1).cast("byte").alias("weight")).toArrow()
    weights = np.zeros(SLOTS, np.uint8)
    weights[found.column("slot").to_numpy()] = found.column("weight").to_numpy()
    return weights


def signatures(docs: DataFrame, weights) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (128 bits of the set; null for an empty one), path (prefix and MORE), bitmap."""

    def run(batch: pa.RecordBatch) -> dict:
        import xxhash

        out: dict = {k: [] for k in ("text_hash", "n_shingles", "set_key", "path", "bitmap")}
        for text in byte_texts(batch.column("text")):
            shingles = shingle_set(text)
            # The same number as Spark's xxhash64 of the text.
            out["text_hash"].append(int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64)))
            out["n_shingles"].append(shingles.size)
            out["set_key"].append(xxhash.xxh3_128_digest(shingles.tobytes()) if shingles.size else None)
            out["path"].append(ordered(shingles, weights.value)[: prefix_length(shingles.size) + MORE].view(np.int64))
            out["bitmap"].append(bitmap(shingles))
        return {"doc_id": batch.column("doc_id")} | out

    schema = "doc_id long, text_hash long, n_shingles long, set_key binary, path array<long>, bitmap binary"
    return map_rows(texts(docs), run, schema)


def _met(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``members`` (node and more) for each u and a block of its v: u's own, marked as probe, then theirs."""
    blocks = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # A block may stay without any v; then its probe finds nothing.
    probes = blocks.select(
        "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("u").alias("node"), F.lit(True).alias("probe")
    )
    met = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64("v"), "blocks").alias("block"), F.col("v").alias("node"), F.lit(False).alias("probe"))
    rows = probes.unionAll(met)
    return rows.join(members, "node").repartition("u", "block").sortWithinPartitions("u", "block", F.col("probe").desc())


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose bitmaps allow a link; none that links is lost. ``sets`` has node, n and bitmap."""
    rows = _met(pairs, sets.select("node", "n", "bitmap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, probe = None, None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in ("u", "block", "node", "probe", "n", "bitmap")]
            for u, block, node, is_probe, n, bits in zip(*columns, strict=True):
                own = (n, np.frombuffer(bits, np.uint8))
                if is_probe:
                    group, probe = (u, block), own
                elif (u, block) == group and 9 * most_shared(*probe, *own) >= 4 * (probe[0] + n):
                    out.append((u, node))
            yield _pairs(out)

    return rows.select("u", "block", "node", "probe", "n", "bitmap").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, members: DataFrame, weights) -> DataFrame:
    """(u, v) of the candidate pairs that link; ``members`` has node and text."""
    rows = _met(pairs, members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, probe, tree = None, None, None

        def settle() -> list[tuple[int, int]]:
            return [(group[0], v) for v in tree.linked(probe)] if group and probe is not None else []

        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in ("u", "block", "node", "probe")]
            for u, block, node, is_probe, text in zip(*columns, byte_texts(batch.column("text")), strict=True):
                if (u, block) != group:
                    out += settle()
                    group, probe, tree = (u, block), None, PrefixTree()
                shingles = shingle_set(text)
                if is_probe:
                    probe = shingles
                else:
                    tree.add(ordered(shingles, weights.value), node)
            yield _pairs(out)
        yield _pairs(settle())

    return rows.select("u", "block", "node", "probe", "text").mapInArrow(run, "u long, v long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    left, right = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])


def _texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes that a pair names; a node carries the row that stands for its set."""
    named = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    keyed = nodes.join(named, "node").select("node", F.col("doc_id").alias("own"), "text_hash")
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    found = rows.join(keyed, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("own")))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _sizes_fit(a, b):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _prefix_shared(a, b):
    """Shingles that linked sets of these sizes share within both prefixes, at least."""
    prefix = lambda n: n - F.ceil(4 * n / 5) + 1
    return F.greatest(
        F.lit(1), F.least(prefix(a) - a + F.ceil(4 * (a + b) / 9), prefix(b) - b + F.ceil(4 * (a + b) / 9))
    )


def distinct_lists(postings: DataFrame) -> DataFrame:
    """The postings of the earliest of all lists that hold the same sets, with the number of these lists, ``times``.

    The first shingle that two sets share stays: an earlier list of the same sets would be one they share.
    Lists are told apart by their length and 128 bits of their sets.
    """
    lists = postings.groupBy("token").agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.min(F.struct("node", "place")).alias("least"),
    )
    # Equal lists have one smallest set, whose places tell which is the earliest.
    first = F.min(F.struct("least.place", "token")).alias("first")
    kept = lists.groupBy("size", "x", "y").agg(first, F.count("*").alias("times"))
    return postings.join(kept.select("first.token", "times"), "token")


def _placed(postings: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """Postings with the component of their set (its own number while there are none) and the list's size, of
    lists with several components."""
    own = postings.withColumn("component", F.col("node"))
    if grouped is not None:
        own = postings.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = own.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    )
    return own.join(lists.where("low < high").select("token", "size"), "token")


def hub_pairs(placed: DataFrame) -> DataFrame:
    """(u, v): the hubs of a posting list with each set of another component that is likely to link.

    Hubs are the smallest set numbers of each of HUBS residues. Rows are numbered as their sets'
    hashes dealt them, so each hub of a group of near copies links its own random share of it.
    """
    hub = F.struct("node", "component")
    own = [F.min(F.when(F.pmod("node", F.lit(HUBS)) == k, hub)).alias(f"h{k}") for k in range(HUBS)]
    hubs = placed.groupBy("token").agg(*own)
    hubs = hubs.select("token", F.array_compact(F.array(*(f"h{k}" for k in range(HUBS)))).alias("hubs"))
    rows = placed.join(hubs, "token").select(F.explode("hubs").alias("hub"), "node", "n", "component", "times")
    rows = rows.where("hub.component <> component").select(F.col("hub.node").alias("u"), F.col("node").alias("v"), "n", "times")
    pairs = rows.groupBy("u", "v").agg(F.sum("times").alias("shared"), F.first("n").alias("b"))
    sizes = placed.groupBy(F.col("node").alias("u")).agg(F.first("n").alias("a"))
    fit = _sizes_fit(F.col("a"), F.col("b")) & (2 * F.col("shared") >= _prefix_shared(F.col("a"), F.col("b")))
    return pairs.join(sizes, "u").where(fit).select("u", "v")


def remaining_pairs(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): all pairs of sets in different components that can still link, found by walks."""
    lists = placed.groupBy("node", "n", "component").agg(F.collect_list(F.struct("place", "token", "size")).alias("lists"))
    short = F.transform("path", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("path")
    rows = lists.join(sets.select("node", short), "node").select("node", "n", "component", "path", F.explode("lists").alias("own"))
    rows = rows.select(
        *("node", "n", "component", "own.token", "own.place"),
        F.slice("path", F.col("own.place") + 2, REST).alias("rest"),
        F.greatest(F.size("path") - F.col("own.place") - 1 - REST, F.lit(0)).cast("long").alias("unseen"),
        F.ceil(F.col("own.size") / CELL).alias("blocks"),
    )
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        *("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block"),
        *("node", "n", "component", F.col("place").cast("long").alias("place"), "unseen", "rest"),
    )
    rows = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            cells = _cells(held)
            start = int(np.searchsorted(cells, cells[-1]))
            if start:
                yield from _forests(held.slice(0, start), cells[:start])
                held = held.slice(start).combine_chunks()
        if held is not None:
            yield from _forests(held, _cells(held))

    return rows.mapInArrow(run, "u long, v long").distinct()


def _cells(rows: pa.Table) -> np.ndarray:
    """A rising number for each run of equal (token, low, high)."""
    keys = [rows.column(k).to_numpy() for k in ("token", "low", "high")]
    return np.cumsum(np.any([np.diff(k, prepend=k[:1]) != 0 for k in keys], axis=0))


def _forests(rows: pa.Table, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of runs of cells that hold about HELD shingles each."""
    last = np.flatnonzero(np.diff(cells, append=cells[-1] + 1))
    ends = rows.column("rest").combine_chunks().offsets.to_numpy()
    shingles = ends[last + 1].astype(np.int64) - ends[0]
    start = 0
    for end in last[np.flatnonzero(np.diff(shingles // HELD, append=-1))] + 1:
        yield _forest_pairs(rows.slice(start, end - start), cells[start:end] - cells[start])
        start = end


def _forest_pairs(rows: pa.Table, cells: np.ndarray) -> pa.RecordBatch:
    rests = rows.column("rest").combine_chunks()
    ends = rests.offsets.to_numpy()
    columns = {k: rows.column(k).to_numpy() for k in ("node", "n", "component", "place", "unseen", "block")}
    whole = rows.column("low").to_numpy() == rows.column("high").to_numpy()
    forest = Forest(
        cells=cells, whole=whole, start=(ends[:-1] - ends[0]).astype(np.int64), length=np.diff(ends).astype(np.int64),
        tokens=rests.values[ends[0] : ends[-1]].to_numpy().astype(np.int64), **columns,
    )
    out = [forest.walk(probes) for probes in forest.shares()]
    low, high = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    pairs = np.unique(np.stack([low, high], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``counts`` items from ``starts``: the run of each item, and the item."""
    run = np.repeat(np.arange(counts.size), counts)
    return run, np.arange(run.size) - np.repeat(np.cumsum(counts) - counts, counts) + starts[run]


class Forest:
    """Prefix trees of many cells, walked by all their sets at once, level by level.

    A cell's largest component has a tree of its own, which its sets do not enter. Each node has the
    least and most size below it, the most shingles still to come and the components' range.
    """

    def __init__(self, cells, whole, node, n, component, place, unseen, block, start, length, tokens):
        self.cells, self.whole, self.node, self.n, self.place = cells, whole, node, n, place
        self.unseen, self.block, self.length = unseen, block, length
        row, at = _spread(start, length)
        self.present = np.zeros((n.size, PLACES), bool)
        self.present[row, tokens[at] % PLACES] = True
        self.components, self.code = np.unique(component, return_inverse=True)
        # The first of two linked sets' common shingles is this early in the shorter one.
        members = np.flatnonzero(place <= n - -(-8 * n // 9))
        of, counts = np.unique(cells[members] * self.components.size + self.code[members], return_counts=True)
        by_size = np.lexsort((counts, of // self.components.size))
        self.largest = np.full(int(cells[-1]) + 1, -1)
        self.largest[of[by_size] // self.components.size] = of[by_size] % self.components.size
        self.members = np.bincount(cells[members], minlength=self.largest.size)

        key = 2 * cells[members] + (self.code[members] == self.largest[cells[members]])
        self.levels, depth, before = [], 0, None
        while members.size:
            names, at = np.unique(key, return_inverse=True)
            level = {"names": names, "slot": (names & 0xFFFFFFFF) % PLACES}
            level["children"] = None if before is None else np.searchsorted(names >> 32, np.arange(before + 1))
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(names.size))
            seen = length[members] - depth
            for name, of, values in (
                ("least", np.minimum, n[members]), ("most", np.maximum, n[members]),
                ("seen", np.maximum, seen), ("rest", np.maximum, seen + unseen[members]),
                ("low", np.minimum, self.code[members]), ("high", np.maximum, self.code[members]),
            ):
                level[name] = of.reduceat(values[order], first)
            done = order[length[members[order]] == depth]
            level["ending"], level["ends"] = members[done], np.searchsorted(at[done], np.arange(names.size + 1))
            self.levels.append(level)
            on = length[members] > depth
            members, key = members[on], at[on] << 32
            key |= tokens[start[members] + depth]
            depth, before = depth + 1, names.size

    def shares(self) -> Iterator[np.ndarray]:
        """All rows, in runs whose walks stay near STEPS."""
        cost = np.cumsum(self.members[self.cells] + 1) // STEPS
        yield from np.split(np.arange(cost.size), np.flatnonzero(np.diff(cost)) + 1)

    def walk(self, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smaller, larger) set numbers of the pairs that may link."""
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not self.levels:
            return low[0], high[0]
        names = self.levels[0]["names"]
        others = probe[self.code[probe] != self.largest[self.cells[probe]]]
        tree = np.concatenate([2 * self.cells[probe], 2 * self.cells[others] + 1])
        probe = np.concatenate([probe, others])
        at = np.minimum(np.searchsorted(names, tree), names.size - 1)
        probe, at = probe[names[at] == tree], at[names[at] == tree]
        shared = np.ones(probe.size, np.int64)
        for depth, level in enumerate(self.levels):
            n = self.n[probe]
            least, most = np.maximum(level["least"][at], -(-4 * n // 5)), np.minimum(level["most"][at], n)
            own = (level["low"][at] == self.code[probe]) & (level["high"][at] == self.code[probe])
            reach = shared + np.maximum(level["rest"][at], level["seen"][at] + self.unseen[probe])
            on = (least <= most) & ~own & (reach >= _both_paths(n, least))
            probe, at, shared = probe[on], at[on], shared[on]

            run, item = _spread(level["ends"][at], level["ends"][at + 1] - level["ends"][at])
            a, b = probe[run], level["ending"][item]
            m, n = self.n[b], self.n[a]
            fit = (m < n) | ((m == n) & (self.node[b] < self.node[a]))
            fit &= (5 * m >= 4 * n) & (self.code[a] != self.code[b]) & (self.whole[a] | (self.block[a] != self.block[b]))
            fit &= np.minimum(n - self.place[a], m - self.place[b]) >= -(-4 * (m + n) // 9)
            # Both paths follow one order, so what is out of sight on either side lies behind one end.
            fit &= shared[run] + np.maximum(self.unseen[a], self.unseen[b]) >= _both_paths(n, m)
            a, b = self.node[a[fit]], self.node[b[fit]]
            low.append(np.minimum(a, b))
            high.append(np.maximum(a, b))

            if depth + 1 == len(self.levels):
                break
            below = self.levels[depth + 1]
            run, at = _spread(below["children"][at], below["children"][at + 1] - below["children"][at])
            probe = probe[run]
            shared = shared[run] + self.present[probe, below["slot"][at]]
        return np.concatenate(low), np.concatenate(high)


def _both_paths(longer, shorter):
    """Shingles that linked sets of these sizes share within both paths, at least."""
    behind = np.maximum(-(-4 * longer // 5) - 1 - MORE, 0)
    return np.maximum(1, -(-4 * (longer + shorter) // 9) - behind)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id, one row per input row.

    The component is the smallest doc_id that links reach, the document itself included. Null texts
    and texts without words have n_shingles 0 and their own id as component. Rows of a null doc_id
    link like others but name no component (null if no linked row has an id). Repeated rows stay;
    rows of one doc_id with different texts are texts of their own. An empty table gives an empty one.
    """
    return numbered_classes(docs).drop("class")


def numbered_classes(docs: DataFrame) -> DataFrame:
    """``classes`` with the number of each class, which ids do not decide; null for texts without words."""
    spark = docs.sparkSession
    folders = [shared_folder(spark) for _ in range(6)]
    weights = spark.sparkContext.broadcast(frequent(docs))
    # Rows and nodes are numbered once and for all by being written.
    signed = stored(signatures(docs, weights).withColumn("at", F.monotonically_increasing_id()), folders[0])
    small = stored(signed.drop("path", "bitmap", "at"), folders[1])
    # One node per distinct set; one of its rows stands for it, of rows that are equal too.
    nodes = (
        signed.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "at")).alias("row"), F.first("n_shingles").alias("n"))
        .select("set_key", "row.doc_id", "row.text_hash", "row.at", "n", F.monotonically_increasing_id().alias("node"))
    )
    nodes = stored(nodes, folders[2])
    sets = stored(
        signed.where("set_key IS NOT NULL").select("at", "path", "bitmap").join(nodes.select("at", "node", "n"), "at").drop("at"),
        folders[3],
    )
    discard(spark, folders[0])
    prefix = F.slice("path", 1, (F.col("n") - F.ceil(4 * F.col("n") / 5) + 1).cast("int"))
    postings = sets.select("node", "n", F.posexplode(prefix).alias("place", "token"))
    # Lists of one set link nothing.
    several = postings.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    postings = stored(postings.join(several.select("token"), "token"), folders[4])
    postings = stored(distinct_lists(postings), folders[5])
    discard(spark, folders[4])

    grouped = None
    # Hubs settle most of a group of near copies; the walks find every pair still between components.
    for round_of in ("hubs", "walks"):
        used = [shared_folder(spark) for _ in range(4)]
        # What several jobs or parts of one read is written before, so that each plan and its number of tasks stay small.
        placed = stored(_placed(postings, grouped), used[0])
        pairs = stored(hub_pairs(placed) if round_of == "hubs" else remaining_pairs(placed, sets), used[1])
        pairs = stored(likely(pairs, sets), used[2])
        links = stored(verified(pairs, _texts_of(pairs, nodes, docs), weights), used[3])
        if not links.isEmpty():
            if grouped is not None:
                links = links.unionAll(grouped.select(F.col("node").alias("u"), F.col("component").alias("v")))
            grouped = stored(components(links))
        for folder in used:
            discard(spark, folder)
    if grouped is None:
        grouped = spark.createDataFrame([], "node long, component long")
    discard(spark, folders[3])
    discard(spark, folders[5])
    whole = nodes.join(grouped, "node", "left").select(
        "set_key", "doc_id", F.coalesce("component", "node").alias("component")
    )
    named = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = whole.join(named, "component").select("set_key", "component_id", F.col("component").alias("class"))
    return small.join(by_set, "set_key", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "class",
    )
