"""The conversation trie, token counts and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lexical, prefix_trie, token_counts

TURNS = "conv_id long, turn long, role string, text string, place string"


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = (*own.get(c - int(math.fmod(c, 20)), [])[:h], *ts[h:])
    nodes = {t[:d] for t in full.values() for d in range(len(t) + 1)}
    members = {n: [c for c, t in full.items() if t[: len(n)] == n] for n in nodes}
    children = {n: {m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n} for n in nodes}
    out = set()
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c, t in full.items() if t == n))
        out.add(
            (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]),
             sum(not children[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def conversations(seed):
    """Common turns, copies, a long chain, one conversation of many rows, ties, nulls and lone turns."""
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 130), -3, -20, 10**15]:
        for turn in range(draw.randint(1, 5)):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["hi", "a b\tc", "", None, "é x"])))
    rows += [(200 + k, t, "user", f"chain {t}") for k in range(3) for t in range(45)]
    rows += [(300, None, "user", "same")] * 40 + [(300, 1, None, "tie"), (300, 1, "", "tie"), (300, 1, "b", "a")]
    rows += [(None, 1, "user", "nobody's"), (341, 0, "user", "lone")]
    draw.shuffle(rows)
    return rows


def trie_rows(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "extra") for r in rows], TURNS).repartition(parts)
    got = prefix_trie.prefix_trie(frame)
    return [tuple(r) for r in got.collect()]


@pytest.fixture
def many_partitions(spark):
    """Small partitions that stay apart, so that conversations cross their borders."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_trie_equals_brute_force(spark, many_partitions):
    rows = conversations(3)
    folders = []
    turns, _ = prefix_trie.rebuilt(spark.createDataFrame([(*r, "extra") for r in rows], TURNS).repartition(3), folders)
    crossed = turns.groupBy("conv_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count()
    assert crossed >= 3
    got = trie_rows(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_edge_tables(spark):
    assert trie_rows(spark, []) == []
    # crc32("7") % 4 is above 0, and conversation 0 does not exist: 7 loses its only turn.
    assert zlib.crc32(b"7") % 4 > 0
    assert set(trie_rows(spark, [(7, 0, "u", "x")])) == brute_trie([(7, 0, "u", "x")])


def test_subtree_totals_of_a_random_tree(spark):
    draw = random.Random(9)
    parent = [None] + [max(0, k - 1 - (draw.randrange(4) == 0) * draw.randrange(min(k, 20))) for k in range(1, 300)]
    values = [draw.randrange(100) for _ in parent]
    total = values.copy()
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    kids = [parent.count(k) for k in range(len(parent))]
    tree = spark.createDataFrame(list(zip(range(300), parent, kids, values)), "id long, parent long, kids long, v long")
    got, _ = prefix_trie.subtree_totals(tree, ["v"])
    assert sorted(map(tuple, got.collect())) == list(enumerate(total))


@pytest.fixture(scope="module")
def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def machine(piece_model):
    return token_counts.Transducer(token_counts.read_vocabulary(piece_model))


def token_texts(vocabulary):
    draw = random.Random(4)
    pieces = [p.replace("▁", " ") for p, _ in vocabulary]
    out = [None, "", " ", "  ", "▁a ", "a" * 3000, " " * 3000, "ab" * 900 + "=" * 700, "日本" * 400, " \n" * 60, "a\x00b", "😀 <s> <0x41>", "iiihh EEEFACE"]
    for _ in range(250):
        out.append("".join(draw.choice(pieces) for _ in range(draw.randint(1, 60))))
        out.append("".join(draw.choice("abtheins  \n.é日Ж") for _ in range(draw.randint(1, 300))))
    return out


@pytest.mark.parametrize("chunk,snap,run_up,segment", [(512, 512, 48, 4_000_000), (64, 8, 48, 4_000_000), (64, 8, 2, 4_000_000), (64, 16, 48, 150)])
def test_token_counts_equal_the_library(machine, piece_model, monkeypatch, chunk, snap, run_up, segment):
    """Chunks with constant maps, with guessed maps, with maps that miss, and texts in segments."""
    import sentencepiece

    for name, value in (("CHUNK", chunk), ("SNAP", snap), ("RUN_UP", run_up), ("SEGMENT", segment)):
        monkeypatch.setattr(token_counts, name, value)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rows = token_texts(token_counts.read_vocabulary(piece_model))
    assert machine.count(rows).tolist() == [len(library.encode(t or "")) for t in rows]


def test_token_counts_survive_an_emptied_table(machine, monkeypatch):
    want = machine.count(["some words of text", "other words"]).tolist()
    monkeypatch.setattr(token_counts, "KEPT", 10)
    assert [machine.count([t])[0] for t in ("some words of text", "other words")] == want


def test_token_count_rows(spark, documents, piece_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    texts = [None, "", "é x", "é x", "word " * 5000]
    rows = token_counts.token_counts(documents(texts, ids=[1, None, 3, 3, 5]), piece_model).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in zip([1, None, 3, 3, 5], texts)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(documents([]), piece_model).count() == 0


def brute_ranking(docs, items, k=20):
    """docs: (doc_id, text); items: (item_id, text)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    terms = [split(t) for _, t in docs]
    n, total = sum(bool(t) for t in terms), sum(map(len, terms))
    out = []
    for item_id, text in set(items):
        scored = []
        for (doc_id, _), words in zip(docs, terms):
            score = 0
            for t in split(text):
                tf, df = words.count(t), sum(t in w for w in terms)
                if tf:
                    m = 100 - 25 + 25 * len(words) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def search_tables(seed):
    draw = random.Random(seed)
    words = ["the", "of", "and", *("".join(draw.choice("abcdé日") for _ in range(draw.randint(1, 3))) for _ in range(60))]
    text = lambda n: " ".join(draw.choice(words[: draw.choice([4, 20, 63])]) for _ in range(n))
    docs = [(k, text(draw.randint(0, 40)).upper() if k % 5 else text(30)) for k in range(150)]
    # A large group of copies, repeated rows, a long text, null ids and texts.
    docs += [(200 + k, docs[0][1]) for k in range(90)] + [(7, "the of"), (7, "the of"), (None, docs[1][1]), (None, docs[1][1])]
    docs += [(500, None), (501, " .,"), (502, text(3000))]
    items = [(k, text(draw.randint(1, 12))) for k in range(12)]
    items += [(0, "the the of"), (3, items[3][1]), (None, docs[1][1]), (50, None), (51, "zzz"), (52, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_equals_brute_force(spark, documents, monkeypatch, seed):
    docs, items = search_tables(seed)
    docs = [docs[k] for k in np.random.default_rng(seed).permutation(len(docs))]
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 9)
    frame = documents([t for _, t in docs], ids=[i for i, _ in docs])
    got = lexical.ranked(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_ranking(docs, items)


def test_terms_of_a_text_in_slices(monkeypatch):
    text = " ".join(f"Word{k % 7} é{k % 3}-x" for k in range(500)).encode()
    want = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "SPLIT_BYTES", 50)
    assert lexical.term_counts(text) == want and want["é1".encode()] == 167 and want[b"x"] == 500


@pytest.mark.parametrize("leaf", [1, 4])
def test_search_over_several_trees(monkeypatch, leaf):
    """Small leaves, copies and equal scores; the list is carried from tree to tree."""
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    mine, best, want = np.where(np.arange(25) % 2 == 0, 10 + np.arange(25) % 3, 0), lexical.Best(20), []
    for part in range(5):
        sizes = rng.integers(0, 8, 90)
        paths = [np.sort(rng.choice(25, s, replace=False)) for s in sizes[:60]]
        paths += [paths[0]] * 30
        tfs, m = [rng.integers(1, 3, p.size) for p in paths], rng.integers(75, 80, 90)
        ids = rng.permutation(1000)[:90] + 1000 * (4 - part)
        tree = lexical.Tree(np.append(0, np.cumsum([p.size for p in paths])), np.concatenate(paths), np.concatenate(tfs), m, ids, np.zeros(90, bool))
        tree.search(mine, best)
        for p, f, size, i in zip(paths, tfs, m.tolist(), ids.tolist()):
            score = sum(int(mine[t]) * (10**9 * int(n) // (1000 * int(n) + 12 * size)) for t, n in zip(p, f))
            want.append((-score, i))
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == sorted(want)[:20]


def test_a_task_cuts_its_rows_into_trees(monkeypatch):
    """Every row is in one tree, whatever the bounds of rows and terms are."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 6, 2500)
    batches = []
    for a in range(0, 2500, 700):
        part = sizes[a : a + 700]
        terms = [sorted(rng.choice(30, n, replace=False).tolist()) for n in part]
        columns = [pa.array(range(a, a + part.size), pa.int64()), pa.array([9] * part.size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array([[1] * n for n in part], pa.list_(pa.int32()))]
        batches.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"]))
    for rows, limit in ((10**9, 10**9), (1000, 10**9), (10**9, 900)):
        monkeypatch.setattr(lexical, "TREE_ROWS", rows)
        monkeypatch.setattr(lexical, "TREE_TERMS", limit)
        trees = list(lexical._trees(iter(batches), np.arange(30), 2500, 22500))
        assert sorted(np.concatenate([t.ids for t in trees]).tolist()) == list(range(2500))
        assert sum(t.terms.size for t in trees) == sizes.sum() and (len(trees) > 1) == (min(rows, limit) < 10**9)


def test_trees_prune_and_stay_exact():
    """The bound of a subtree is never below the score of a document in it."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 12, 400)
    ranks = np.concatenate([rng.choice(40, s, replace=False) for s in sizes]).astype(np.int64)
    tfs, m = rng.integers(1, 9, ranks.size), rng.integers(75, 400, 400)
    lexical_leaf, lexical.LEAF = lexical.LEAF, 4
    try:
        tree = lexical.Tree(np.append(0, np.cumsum(sizes)), ranks, tfs, m, np.arange(400), np.zeros(400, bool))
    finally:
        lexical.LEAF = lexical_leaf
    mine = np.where(np.arange(40) % 3 == 0, 10 + np.arange(40), 0)
    for node in range(len(tree.first)):
        best = lexical.Best(1)
        tree._score(mine, tree.first[node], tree.end[node], best)
        if best.scores.size:
            assert tree._bounds(mine, node, node + 1)[0] >= best.scores[0]


def test_ranking_edge_tables(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(documents([]), items).count() == 0
    assert lexical.ranked(documents([None, ""]), items).count() == 0
    assert lexical.ranked(documents(["a"]), items.where("false")).count() == 0
