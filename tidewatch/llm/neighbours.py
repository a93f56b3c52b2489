"""Nearest neighbours by largest inner product, through stable projections and a kd-tree.

Vectors are lifted by one coordinate so that the largest inner product becomes the smallest
Euclidean distance. AXES random Gaussian projections (2-stable: a projected squared distance is the
squared distance times a chi-square variable of AXES degrees of freedom) are indexed by a kd-tree,
one tree for each shard of rows. A query takes its neighbours in the projected space in
growing rings, leaf by leaf, verifies them on the original vectors, and stops when the chi-square test says
that a vector nearer than the k-th verified one would hardly lie as far out in projection as the
next ring does. Queries that reach a leaf in the same round are verified by one product of matrices.

Every row is indexed. Queries are sent to the shards in blocks and the best k of all shards are
merged, so no task holds all vectors or all queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AXES = 8
LEAF = 128
#: Factor by which the squared radius of a search grows from ring to ring.
GROWTH = 1.35
#: Chance that a vector as near as the k-th is missed when the search of a shard stops; nearer ones are
#: missed less. Measured recall of the whole is in the README.
MISS = 0.1
#: Rows of a shard and queries of a block, about, and queries that are searched together.
SHARD_ROWS = 8192
QUERY_ROWS = 4096
TOGETHER = 512
#: By so much a product of matrices may differ from the sum of one pair's products, at lengths near one.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (array<double>) of the rows that take part.

    Left out: null ids and embeddings, null or non-finite components, vectors of zeros only.
    """
    value = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))


def chi_square_tail(x: float, degrees: int) -> float:
    """P(chi-square > x) for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= half / k
        total += term
    return math.exp(-half) * total


def stop_factor(miss: float = MISS, degrees: int = AXES) -> float:
    """The value that a chi-square variable exceeds with probability ``miss``."""
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > miss else (low, middle)
    return high


def projection(dimensions: int) -> np.ndarray:
    return np.random.default_rng(29).normal(size=(dimensions + 1, AXES))


class Tree:
    """A kd-tree over projected points: split at the median of the widest axis, down to leaves.

    ``order`` lists the points leaf by leaf; ``floor`` and ``ceiling`` are the leaves' boxes.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        cuts, boxes, stack = [], [], [(0, len(points))] if len(points) else []
        while stack:
            low, high = stack.pop()
            own = self.order[low:high]
            part = points[own]
            floor, ceiling = part.min(axis=0), part.max(axis=0)
            axis = int(np.argmax(ceiling - floor))
            if high - low <= LEAF:
                cuts.append((low, high))
                boxes.append((floor, ceiling))
                continue
            middle = (high - low) // 2
            self.order[low:high] = own[np.argpartition(part[:, axis], middle)]
            stack += [(low + middle, high), (low, low + middle)]
        self.cuts = np.array(cuts).reshape(-1, 2)
        self.points = points[self.order]
        self.floor = np.array([f for f, _ in boxes])
        self.ceiling = np.array([c for _, c in boxes])

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """Least squared distance from each place to each leaf's box."""
        out = np.zeros((len(places), len(self.cuts)))
        for axis in range(places.shape[1]):
            at = places[:, axis, None]
            out += np.maximum(0, np.maximum(self.floor[:, axis] - at, at - self.ceiling[:, axis])) ** 2
        return out


class Shard:
    """The rows of one shard with their index; vectors lie in the tree's order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        lengths = (vectors**2).sum(axis=1)
        lifted = np.hstack([vectors / longest, np.sqrt(np.maximum(0, 1 - lengths / longest**2))[:, None]])
        self.axes = projection(vectors.shape[1])
        self.tree = Tree(lifted @ self.axes)
        self.ids, self.vectors, self.longest = ids[self.tree.order], vectors[self.tree.order], longest
        self.stop = stop_factor()

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best k found for each of a block of queries, by their places in the block.

        Every query goes out in rings of its own: a leaf is verified for all queries whose ring has reached it, and a
        query stops when its ring has passed the chi-square bound of its k-th score. Its own id is left out. Largest
        score, then smallest id.
        """
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        unit = np.hstack([queries / lengths[:, None], np.zeros((len(queries), 1))])
        bounds = self.tree.bounds(unit @ self.axes)
        radius = bounds.min(axis=1) + 1.0
        best = _Best(len(queries), k)
        waiting, active = np.ones(bounds.shape, bool), np.ones(len(queries), bool)
        while active.any():
            reached = waiting & active[:, None] & (bounds <= radius[:, None])
            for leaf in np.flatnonzero(reached.any(axis=0)).tolist():
                low, high = self.tree.cuts[leaf]
                own = np.flatnonzero(reached[:, leaf])
                rough = queries[own] @ self.vectors[low:high].T
                q, row = np.nonzero((rough >= (best.kth - SLACK * lengths * self.longest)[own, None]) & (query_ids[own, None] != self.ids[low:high]))
                if q.size:
                    q, row = own[q], row + low
                    # Summed in one way for every pair, so that equal vectors score alike.
                    best.offer(q, self.ids[row], np.einsum("ij,ij->i", queries[q], self.vectors[row]))
            waiting &= ~reached
            # Squared distance of lifted, unit vectors: 2 - 2 * score / (|query| * longest).
            with np.errstate(invalid="ignore"):
                enough = self.stop * np.maximum(0.0, 2 - 2 * best.kth / (lengths * self.longest))
            active &= waiting.any(axis=1) & ~((best.kth > -np.inf) & (radius >= enough))
            radius *= GROWTH
        return best.rows()


class _Best:
    """The k best of each query so far, best first; places that are not filled yet hold minus infinity."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.kth = self.scores[:, k - 1]

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, owner, more = np.unique(query, return_inverse=True, return_counts=True)
        k = self.scores.shape[1]
        q = np.concatenate([np.repeat(np.arange(touched.size), k), owner])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        s = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((i, -s, q))
        first = np.append(0, np.cumsum(more + k)[:-1])
        kept = order[first[:, None] + np.arange(k)]
        self.scores[touched], self.ids[touched] = s[kept], i[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.scores > -np.inf)
        return query, self.ids[query, place], self.scores[query, place]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those
    of the query's own id. Rows that ``usable`` leaves out take no part. Vectors of another
    length than the query's are no candidates. Ties go to the smaller vec_id; repeated ids are
    candidates once for each different vector, and a repeated query id takes its smallest vector. An
    empty table gives an empty table.
    """
    rows = usable(vectors).withColumn("dims", F.size("embedding")).distinct()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("longest"))
    shards = rows.join(counts, "dims").withColumn(
        "shard", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / SHARD_ROWS))
    )
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "dims").agg(F.min("embedding").alias("embedding"))
    queries = queries.join(counts, "dims")
    blocks = F.ceil(F.col("n") / every / QUERY_ROWS).cast("int")
    each = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / SHARD_ROWS) - 1).cast("int")))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks).cast("int")
    sent = queries.select("dims", each.alias("shard"), block.alias("block"), "vec_id", "embedding", "longest", F.lit(True).alias("query"))
    held = shards.select("dims", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "vec_id", "embedding", "longest", F.lit(False).alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by (dims, shard, block of queries), the shard's own rows first.
        key, index, rows, asked, longest = None, None, ([], []), ([], []), 1.0

        def answer() -> pa.RecordBatch:
            nonlocal index, asked
            ids, parts = asked
            asked = ([], [])
            if index is None and rows[0] and ids:
                index = Shard(np.concatenate(rows[0]), np.concatenate(rows[1]), longest)
            if index is None or not ids:
                return _found([], [], [])
            ids = np.concatenate(ids)
            query, found, score = index.nearest(ids, np.concatenate(parts), k)
            return _found(ids[query], found, score)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "shard", "block", "query")], axis=1)
            borders = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, batch.num_rows)
            ids, far = batch.column("vec_id").to_numpy(), batch.column("longest").to_numpy()
            flat, begin, start = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), 0, 0
            for end in borders.tolist():
                dims, shard, block, is_query = keys[start].tolist()
                size = (end - start) * dims
                part = flat[begin : begin + size].reshape(-1, dims)
                if (dims, shard, block) != key:
                    yield answer()
                    key, index, rows, longest = (dims, shard, block), None, ([], []), float(far[start])
                # A few hundred queries at a time bound the table of their distances to all leaves.
                step = TOGETHER if is_query else max(1, end - start)
                for at in range(0, end - start, step):
                    # Answering begins a new list of queries.
                    side = asked if is_query else rows
                    side[0].append(ids[start + at : min(end, start + at + step)].copy())
                    side[1].append(part[at : at + step].copy())
                    if is_query and sum(map(len, asked[0])) >= TOGETHER:
                        yield answer()
                begin, start = begin + size, end
        yield answer()

    dealt = held.unionAll(sent).repartition("dims", "shard", "block").sortWithinPartitions("dims", "shard", "block", "query", "vec_id")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(query, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())],
        names=["query_id", "vec_id", "score"],
    )
