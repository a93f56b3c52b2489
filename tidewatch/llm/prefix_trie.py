"""The prefix trie of all conversations, with subtree totals by parallel tree contraction.

1. Turns are range-sorted over all tasks, so a long conversation lies in many partitions. What a partition
   needs from those in front of it (places and prefix hashes of the one conversation that crosses the border) is
   one row for each partition. Prefix hashes are two 64-bit polynomials, which join at borders.
2. A node is a (depth, prefix hash); one aggregate gives its members, another its children.
3. Subtree totals: each round rakes all leaves (their total is final and goes to the parent, summed
   first) and compresses chains: a node with one child is taken out if a hash ranks it above
   its parent and its child, its own share goes to the parent and its child moves up. About a third of a chain
   goes in every round. Then the rounds are undone from the last to the first: a node taken out in a
   round has its own share plus the total of the child it had then. Tables shrink and grow geometrically.
4. Ends of a node are packed into strings of bounded length in their order and hashed as a stream.

Joins have one row for each key on both sides, but for looking up parents: nodes with more
children than a fourth of a partition's share are joined by broadcast; there are fewer than four for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, shared_folder, stored

#: Turns that a conversation takes over from the first of its twenty at most, and the twenty.
HEAD, FAMILY = 3, 20
#: Conversation ids packed into one string before hashing.
PACKED = 4096

#: Odd bases of the two prefix hashes.
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)

PLACED = "part int, conv_id long, place long, a long, b long, up_a long, up_b long, h1 long, h2 long, tokens long"
PACKS = "node string, first long, ids string"


def head_turns() -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("long")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places from 1 and prefix hashes inside this partition's part of each conversation."""
    part, open_id, place, state = TaskContext.get().partitionId(), None, 0, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy()
        turns = [batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")]
        first = np.append(True, ids[1:] != ids[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        steps = np.arange(n) - start + 1
        carried = (start == 0) & (ids[0] == open_id if open_id is not None else False)
        out, above = [], []
        for k in range(2):
            with np.errstate(over="ignore"):
                power, back = _powers(_BASES[k], n), _powers(_INVERSE[k], n)
                total = np.append(np.uint64(0), np.cumsum(turns[k] * back[:n], dtype=np.uint64))
                own = power[:n] * (total[1:] - total[start])
                own += np.where(carried, state[k] * power[steps], np.uint64(0))
                out.append(own)
                above.append((own - turns[k]) * _INVERSE[k])
        places = steps + np.where(carried, place, 0)
        open_id, place, state = ids[-1], int(places[-1]), [out[0][-1], out[1][-1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part, np.int32)),
                batch.column("conv_id"),
                pa.array(places),
                *(pa.array(x.view(np.int64)) for x in (*out, *above)),
                batch.column("h1"),
                batch.column("h2"),
                batch.column("tokens"),
            ],
            names=["part", "conv_id", "place", "a", "b", "up_a", "up_b", "h1", "h2", "tokens"],
        )


def _carries(placed: DataFrame) -> dict[int, tuple]:
    """For each partition whose first conversation began before: (conv_id, place, hashes) at its border.

    One row for each partition comes to the driver, as in a range partitioner.
    """
    last = F.max(F.struct("conv_id", "place", "a", "b")).alias("last")
    rows = placed.groupBy("part").agg(F.min("conv_id").alias("first"), last).orderBy("part").collect()
    out, end = {}, None
    for r in rows:
        conv, place, a, b = r.last
        if end is not None and r.first == end[0]:
            out[r.part] = end
            if conv == end[0]:
                joined = [
                    (int(end[2 + k]) * pow(int(_BASES[k]), place, 1 << 64) + x) % (1 << 64) for k, x in enumerate((a, b))
                ]
                end = (conv, place + end[1], *(x - (1 << 64) if x >> 63 else x for x in joined))
                continue
        end = (conv, place, a, b)
    return out


def _joined(placed: DataFrame) -> DataFrame:
    """Places and hashes over borders of partitions."""
    carries = _carries(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            parts, ids = columns["part"].to_numpy(), columns["conv_id"].to_numpy()
            place = columns["place"].to_numpy().copy()
            hashes = {c: columns[c].to_numpy().view(np.uint64).copy() for c in ("a", "b", "up_a", "up_b")}
            for part in np.unique(parts).tolist():
                carry = carries.get(part)
                if carry is None:
                    continue
                at = np.flatnonzero((parts == part) & (ids == carry[0]))
                if not at.size:
                    continue
                steps = place[at]
                for k, names in enumerate((("a", "up_a"), ("b", "up_b"))):
                    with np.errstate(over="ignore"):
                        power = _powers(_BASES[k], int(steps.max()))
                        before = np.uint64(carry[2 + k] % (1 << 64))
                        hashes[names[0]][at] += before * power[steps]
                        hashes[names[1]][at] += before * power[steps - 1]
                place[at] += carry[1]
            columns["place"] = pa.array(place)
            columns |= {c: pa.array(x.view(np.int64)) for c, x in hashes.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return placed.mapInArrow(run, PLACED)


def _kept(frame: DataFrame, folders: list[str]) -> DataFrame:
    """The frame stored in a folder that is noted for deletion."""
    folders.append(shared_folder(frame.sparkSession))
    return stored(frame, folders[-1])


def _ordered(rows: DataFrame, keys: list, folders: list[str]) -> DataFrame:
    """``rows`` (conv_id, h1, h2, tokens and key columns) with places and prefix hashes by ``keys``."""
    dealt = rows.repartitionByRange("conv_id", *keys).sortWithinPartitions("conv_id", *keys)
    return _joined(_kept(dealt.select("conv_id", "h1", "h2", "tokens").mapInArrow(_place, PLACED), folders))


def rebuilt(conversations: DataFrame, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """(turns, members): rebuilt turns with depth and prefix hashes, and every conv_id once.

    Turns of one conversation with the same number come in order of role, then text. Rows without
    conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    hashed = turns.select(
        "*",
        F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "text", "role").alias("h2"),
        F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        # Tells rows apart that are the same, so that they need not stay together.
        F.monotonically_increasing_id().alias("row"),
    )
    own = _kept(_ordered(hashed, [F.asc_nulls_first("turn"), "role", "text", "row"], folders), folders)
    members = own.select("conv_id").distinct()
    heads = own.where((F.col("place") <= HEAD) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.select(F.col("conv_id").alias("family"), "place", "h1", "h2", "tokens")
    asking = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), head_turns().alias("h"))
    taken = asking.join(heads, "family").where(F.col("place") <= F.col("h"))
    columns = ["conv_id", "segment", "place", "h1", "h2", "tokens"]
    both = taken.withColumn("segment", F.lit(0)).select(*columns).unionAll(
        own.where(F.col("place") > head_turns()).withColumn("segment", F.lit(1)).select(*columns)
    )
    turns = _kept(_ordered(both, ["segment", "place"], folders), folders)
    return turns.withColumnRenamed("place", "depth"), members


def _nodes(turns: DataFrame, members: DataFrame, folders: list[str]) -> DataFrame:
    """id, depth, a, b, conv_id, n_convs, tokens, n_children, parent (id) and parent_conv_id of every node."""
    spark = turns.sparkSession
    zero = [F.lit(0).cast("long").alias(c) for c in ("a", "b", "up_a", "up_b", "tokens")]
    visits = turns.select("conv_id", "depth", "a", "b", "up_a", "up_b", "tokens").unionAll(
        members.select("conv_id", F.lit(0).cast("long").alias("depth"), *zero)
    )
    nodes = visits.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *(F.max(c).alias(c) for c in ("up_a", "up_b", "tokens")),
    )
    nodes = _kept(nodes.withColumn("id", F.monotonically_increasing_id()), folders)
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    nodes = nodes.join(below.agg(F.count("*").alias("n_children")), ["depth", "a", "b"], "left").fillna(0, ["n_children"])
    nodes = _kept(nodes, folders)
    # Parents with many children: their number is bounded by that of the partitions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("n_children") > nodes.count() / (4 * parts)
    key = [(F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b")]
    named = [F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")]
    on = ["depth", "up_a", "up_b"]
    seen = nodes.join(F.broadcast(nodes.where(hot).select(*key, *named)), on, "left")
    cold = nodes.where(~hot & (F.col("n_children") > 0)).select(*key, *named)
    rest = seen.where(F.col("parent").isNull()).drop("parent", "parent_conv_id").join(cold, on, "left")
    return _kept(seen.where(F.col("parent").isNotNull()).unionByName(rest), folders)


_LIVE, _RAKED, _TAKEN = 0, 1, 2


def _contracted(tree: DataFrame, values: list[str]) -> list[tuple[DataFrame, str]]:
    """The tables of all rounds: id, parent, child, kids, fate and the values so far, as of the round's end.

    ``tree`` has id, parent (null at the root), kids and values.
    """
    spark = tree.sparkSession
    rounds: list[tuple[DataFrame, str]] = []
    live = tree
    while True:
        # What the nodes left give their parents: sums of leaves, and the one child of a chain.
        leaf = F.col("kids") == 0
        given = live.where(F.col("parent").isNotNull()).groupBy("parent").agg(
            *(F.sum(F.when(leaf, F.col(v))).alias(f"more_{v}") for v in values),
            F.count(F.when(~leaf, 1)).alias("left"),
            F.min(F.when(~leaf, F.col("id"))).alias("child"),
        )
        given = given.withColumnRenamed("parent", "id")
        raised = live.join(given, "id", "left").select(
            "id",
            "parent",
            F.col("kids").alias("had"),
            F.coalesce("left", F.lit(0)).alias("kids"),
            F.when(F.col("left") == 1, F.col("child")).alias("child"),
            *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values),
        )
        number = F.lit(len(rounds))
        above = F.xxhash64("id", number)
        chosen = (above > F.xxhash64("parent", number)) & (above > F.xxhash64("child", number))
        fate = F.when((F.col("had") == 0) | F.col("parent").isNull() & (F.col("kids") == 0), _RAKED)
        fate = fate.when(F.col("parent").isNotNull() & F.col("child").isNotNull() & chosen, _TAKEN).otherwise(_LIVE)
        folder = shared_folder(spark)
        now = stored(raised.select("id", "parent", "child", "kids", *values, fate.alias("fate")), folder)
        rounds.append((now, folder))
        if now.where(F.col("fate") != _RAKED).isEmpty():
            return rounds
        # Chains close over the nodes taken out: child and parent hear of it, each in one row.
        taken = now.where(F.col("fate") == _TAKEN)
        nothing = [F.lit(0).cast("long").alias(f"add_{v}") for v in values]
        news = taken.select(F.col("child").alias("id"), F.col("parent").alias("up"), *nothing).unionAll(
            taken.select(F.col("parent").alias("id"), F.lit(None).cast("long"), *(F.col(v) for v in values))
        )
        news = news.groupBy("id").agg(F.max("up").alias("up"), *(F.sum(f"add_{v}").alias(f"add_{v}") for v in values))
        live = now.where(F.col("fate") == _LIVE).join(news, "id", "left").select(
            "id",
            F.coalesce("up", "parent").alias("parent"),
            "kids",
            *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values),
        )


def subtree_totals(tree: DataFrame, values: list[str]) -> tuple[DataFrame, str]:
    """id and the sum of each value over the node's subtree, and the folder of the result.

    ``tree`` has id, parent (null at the root), kids (children) and long ``values``; one tree or none.
    """
    spark = tree.sparkSession
    rounds = _contracted(tree.select("id", "parent", F.col("kids").cast("long").alias("kids"), *values), values)
    known, folder = None, ""
    for now, round_folder in reversed(rounds):
        raked = now.where(F.col("fate") == _RAKED).select("id", *values)
        if known is None:
            total = raked
        else:
            below = known.select(F.col("id").alias("child"), *(F.col(v).alias(f"below_{v}") for v in values))
            opened = now.where(F.col("fate") == _TAKEN).join(below, "child")
            total = known.unionAll(raked).unionAll(opened.select("id", *((F.col(v) + F.col(f"below_{v}")).alias(v) for v in values)))
        old, folder = folder, shared_folder(spark)
        known = stored(total, folder)
        discard(spark, round_folder)
        if old:
            discard(spark, old)
    return known, folder


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, in their order, as comma-joined strings of at most ``PACKED`` ids."""
    key, held = None, []

    def flush():
        return {"node": key, "first": held[0], "ids": ",".join(map(str, held))}

    schema = pa.schema([("node", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        out = []
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (node != key or len(held) == PACKED):
                out.append(flush())
                held = []
            key = node
            held.append(conv)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([flush()], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the packed strings of each node, joined by commas, as they stream by."""
    key, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if state is not None and node == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                nodes.append(key)
                digests.append(state.hexdigest())
            key, state = node, hashlib.sha256(ids.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(digests)], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def _ends(turns: DataFrame, members: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of each node at which a conversation ends."""
    zero = F.lit(0).cast("long")
    visits = turns.select("conv_id", "depth", "a", "b").unionAll(
        members.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    )
    last = visits.groupBy("conv_id").agg(F.max_by(F.struct("depth", "a", "b"), "depth").alias("end"))
    keyed = last.select(F.concat_ws(":", "end.depth", "end.a", "end.b").alias("node"), "conv_id")
    # By ranges, so that the ends of one node may lie in many partitions.
    packed = keyed.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pack, PACKS)
    digests = packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digest, "node string, ends_sha256 string")
    parts = F.split("node", ":")
    return digests.select(*(parts[k].cast("long").alias(c) for k, c in enumerate(("depth", "a", "b"))), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of a rebuilt conversation, with members and subtree totals.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation is
    rebuilt from the first turns of its family's first one (conv_id - conv_id % 20, remainder with the sign of conv_id)
    and its own later ones. Turns are ordered by number, null first, then role, then text; equal rows are
    turns of their own. Null role and text are empty; rows with null conv_id take no part. A conversation
    that loses all its turns ends at the root. Other columns are not read. An empty table gives an empty
    table. Texts of any length are hashed and counted whole.
    """
    spark = conversations.sparkSession
    folders: list[str] = []
    turns, members = rebuilt(conversations, folders)
    nodes = _nodes(turns, members, folders)
    saved = ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens")
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    totals, totals_folder = subtree_totals(
        nodes.select("id", "parent", F.col("n_children").alias("kids"), leaf, saved), ["n_leaves", "saved_tokens"]
    )
    ends = _ends(turns, members)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(totals, "id").join(ends, ["depth", "a", "b"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    result = stored(out)
    for folder in [*folders, totals_folder]:
        discard(spark, folder)
    return result
