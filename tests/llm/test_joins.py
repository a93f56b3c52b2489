"""Operators that compare texts or vectors, against brute force."""

import random

import numpy as np
import pytest

from tidewatch.llm import components, decontaminate, jaccard, neighbours, substrings


def varied(seed, groups=12, words=90):
    """Near copies in chains, exact copies, short and empty texts."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    out = [None, "", " \n ", "one two", "One TWO", "one two three four five", "x"]
    for _ in range(groups):
        base = [word() for _ in range(random.randint(30, words))]
        out.append(" ".join(base))
        for _ in range(random.randint(1, 5)):
            base = base.copy()
            for _ in range(random.randint(0, 2)):
                base[random.randrange(len(base))] = word()
            out.append("  ".join(base).upper() if random.random() < 0.2 else " ".join(base))
    random.shuffle(out)
    return out


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(documents, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HUBS", seed)
    texts = varied(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(texts)).collect()}
    assert got == brute_classes(texts)


def test_jaccard_edge_rows(documents):
    assert jaccard.classes(documents([])).count() == 0
    rows = jaccard.classes(documents(["a b", "a b", "a b", None], ids=[5, 5, None, None])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 1, 5), (5, 1, 5), (5, 1, 5)]


def test_prefix_tree_equals_all_pairs():
    rng = np.random.default_rng(8)
    weights = np.zeros(jaccard.SLOTS, np.uint8)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.integers(0, 40, rng.integers(0, 8))] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(s[: rng.integers(25, 41)]))
    tree = jaccard.PrefixTree()
    for k, s in enumerate(sets):
        tree.add(jaccard.ordered(s, weights), k)
    for s in sets:
        want = {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(tree.linked(s)) == want


def near_misses(seed, rows):
    """One long passage in every text, each with as many words of its own as leave it near 0.8; some copies."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(80)]
    out = []
    for k in range(rows):
        text = passage[rng.randint(0, 3) :] + [f"own{k}-{j}" for j in range(rng.randint(9, 16))]
        if k % 3 == 0:
            text[rng.randint(10, 60)] = f"edit{k}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("cell", "rest", "hubs"), [(4096, 128, 1), (16, 128, 1), (4096, 3, 1), (16, 3, 8)])
def test_jaccard_of_a_passage_in_every_text(documents, monkeypatch, cell, rest, hubs):
    for name, value in (("CELL", cell), ("REST", rest), ("HUBS", hubs)):
        monkeypatch.setattr(jaccard, name, value)
    texts = near_misses(cell + rest, 90) + near_misses(1, 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(texts)).collect()}
    assert got == brute_classes(texts)
    assert 1 < len({c for _, c in got.values()}) < len(texts)


@pytest.mark.parametrize(("rest", "steps", "parts"), [(99, 1 << 20, 1), (99, 40, 1), (4, 40, 1), (99, 1 << 20, 3)])
def test_forest_walk_equals_all_pairs(monkeypatch, rest, steps, parts, more=3):
    """Cells of sets with one shingle in common: no linked pair is lost, others only as the bounds allow."""
    monkeypatch.setattr(jaccard, "STEPS", steps)
    monkeypatch.setattr(jaccard, "MORE", more)
    monkeypatch.setattr(jaccard, "PLACES", 1 << 18)
    rng = random.Random(rest + steps + parts)
    cells, sets = [], []
    for cell in range(12):
        for _ in range(rng.choice([1, 2, 30])):
            size = rng.randint(30, 38)
            own = rng.randint(0, 6)
            sets.append([0, *sorted(rng.sample(range(1, 40), size - own)), *(1000 * len(sets) + 1000 + k for k in range(own))])
            cells.append(cell)
    n = np.array([len(s) for s in sets])
    paths = [s[1 : jaccard.prefix_length(len(s)) + jaccard.MORE] for s in sets]
    unseen = np.array([max(0, len(p) - rest) for p in paths])
    paths = [p[:rest] for p in paths]
    length = np.array([len(p) for p in paths])
    component = np.array([rng.choice([k, 7, 7, 8]) for k in range(len(sets))])
    block = np.array([rng.randrange(parts) for _ in sets])
    forest = jaccard.Forest(
        cells=np.array(cells), whole=np.full(n.size, parts == 1), node=np.arange(n.size), n=n, component=component,
        place=np.zeros(n.size, np.int64), unseen=unseen, block=block, start=np.cumsum(length) - length, length=length,
        tokens=np.array([t for p in paths for t in p], np.int64),
    )
    got = set()
    for share in forest.shares():
        got |= set(zip(*(x.tolist() for x in forest.walk(share)), strict=True))
    linked, allowed = set(), set()
    for b in range(n.size):
        for a in range(b):
            if cells[a] != cells[b] or component[a] == component[b] or (parts > 1 and block[a] == block[b]):
                continue
            short, long = sorted((int(n[a]), int(n[b])))
            both = len(set(sets[a]) & set(sets[b]))
            if 100 * both >= 80 * (short + long - both):
                linked.add((a, b))
            seen = 1 + len(set(paths[a]) & set(paths[b])) + max(unseen[a], unseen[b])
            behind = max(0, long - jaccard.prefix_length(long) - jaccard.MORE)
            if 5 * short >= 4 * long and seen >= max(1, jaccard.needed(short, long) - behind):
                allowed.add((a, b))
    assert linked
    assert linked <= got == allowed


def test_lists_of_the_same_sets_stay_once(spark):
    """Of equal lists the earliest stays and counts them all; other lists are untouched."""
    lists = {50: [1, 2, 3], 7: [1, 2, 3], 30: [1, 2, 3], 9: [2, 3], 11: [1, 2], 40: [1, 2], 12: [4, 5, 6]}
    order = [40, 30, 50, 7, 9, 11, 12]
    rows = [(node, order.index(token), token) for token, nodes in lists.items() for node in nodes]
    got = jaccard.distinct_lists(spark.createDataFrame(rows, "node long, place int, token long")).collect()
    assert sorted((r.token, r.node, r.times) for r in got) == sorted(
        (token, node, times) for token, times in ((30, 3), (40, 2), (9, 1), (12, 1)) for node in lists[token]
    )


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(3)
    left_out = 0
    for _ in range(400):
        size = int(rng.integers(1, 700))
        base = rng.integers(0, 2**63, 2 * size + 9).astype(np.uint64)
        a, b = (np.unique(base[start : start + size + more]) for start, more in ((0, 0), (int(rng.integers(0, size)), int(rng.integers(0, 9)))))
        both = np.intersect1d(a, b).size
        most = jaccard.most_shared(a.size, *(np.frombuffer(jaccard.bitmap(a), np.uint8), b.size, np.frombuffer(jaccard.bitmap(b), np.uint8)))
        assert both <= most <= min(a.size, b.size)
        left_out += 9 * most < 4 * (a.size + b.size)
    assert left_out > 200


def test_only_pairs_that_may_link_are_verified(documents, monkeypatch):
    """Texts that share a long passage but no link: few lists are walked, no text of theirs is read again."""
    rows, pairs = [], []
    lists, verify = jaccard.distinct_lists, jaccard.verified

    def counted(postings):
        out = lists(postings)
        rows.append((postings.count(), out.count()))
        return out

    def seen(candidates, members, weights):
        pairs.append(candidates.count())
        return verify(candidates, members, weights)

    monkeypatch.setattr(jaccard, "distinct_lists", counted)
    monkeypatch.setattr(jaccard, "verified", seen)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join(passage + [f"own{k}-{j}" for j in range(70)]) for k in range(30)]
    texts += [texts[0] + " end", texts[0] + " end"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(texts)).collect()}
    assert got == brute_classes(texts)
    assert rows[0][1] * 4 < rows[0][0]
    assert sum(pairs) <= 3


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_of_repeated_rows(documents, seed):
    """Rows that are there twice, with their ids, change no class."""
    texts = varied(seed, groups=6)
    ids = [*range(len(texts))] * 2
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(documents(texts * 2, ids=ids)).collect()}
    assert got == {(k, *v) for k, v in brute_classes(texts).items()}


def test_jaccard_with_small_forests(documents, monkeypatch):
    """Each cell in a forest of its own."""
    monkeypatch.setattr(jaccard, "HELD", 50)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    texts = near_misses(5, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(texts)).collect()}
    assert got == brute_classes(texts)


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_a_settled_forest_takes_no_round_and_a_chain_few(spark, monkeypatch):
    """Every half round is a job of the driver."""
    written, write = [], components.stored
    monkeypatch.setattr(components, "stored", lambda *args: written.append(1) or write(*args))

    def run(edges):
        written.clear()
        found = components.components(spark.createDataFrame(edges, "u long, v long"))
        return {r.node: r.component for r in found.collect()}, len(written)

    assert run([]) == ({}, 1)
    assert run([(k, 3) for k in range(4, 30)] + [(2, 2)]) == (dict.fromkeys(range(3, 30), 3), 1)
    # Two components of one node number apart, an edge twice and a node with two smaller ones.
    assert run([(5, 4), (5, 3), (4, 5), (9, 8)]) == ({3: 3, 4: 3, 5: 3, 8: 8, 9: 8}, 3)


def test_components_equal_a_plain_search(spark):
    draw = random.Random(11)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)]
    root = {k: k for e in edges for k in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if any(k in e for e in edges if e[0] != e[1])}
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len(want) and {r.node: r.component for r in found} == want


def test_frequent_shingles_take_jobs_that_partitions_do_not_add_to(spark, documents):
    """One job for each partition filled the driver; the weights are those of plain counts."""
    draw = random.Random(3)
    common = " ".join(f"c{k}" for k in range(25))
    texts = [common + " " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    counts = np.zeros(jaccard.SLOTS, np.int64)
    for text in texts:
        counts[np.unique(jaccard.shingle_set(text.encode()) & np.uint64(jaccard.SLOTS - 1))] += 1
    want = np.where(counts >= 8, [1 + int(n).bit_length() for n in counts], 0)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = jobs()
        got = jaccard.frequent(documents(texts).coalesce(1))
        assert jobs() - before <= 2
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert np.array_equal(got, want) and np.count_nonzero(got) >= 20


def test_each_block_of_a_probe_meets_it_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    pairs = [(1, k) for k in range(10, 40)] + [(2, 10)]
    members = spark.createDataFrame([(k, k + 100) for k in (1, 2, *range(10, 40))], "node long, n long")
    rows = jaccard._met(spark.createDataFrame(pairs, "u long, v long"), members).collect()
    assert sorted((r.u, r.node) for r in rows if not r.probe) == pairs
    probes = [(r.u, r.block, r.n) for r in rows if r.probe]
    assert sorted(probes) == [(1, k, 101) for k in range(8)] + [(2, 0, 102)]
    assert {(r.u, r.block) for r in rows} == {x[:2] for x in probes}


def brute_kept(rows):
    words = [(k, (t or "").split()) for k, t in rows]
    starts = {}
    for k, w in words:
        for at in range(len(w) - 49):
            starts.setdefault(tuple(w[at : at + 50]), set()).add(k)
    out = {}
    for k, w in words:
        gone = [False] * len(w)
        for at in range(len(w) - 49):
            if min(starts[tuple(w[at : at + 50])]) < k:
                gone[at : at + 50] = [True] * 50
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("large", [1, 60_000])
def test_repeated_passages(documents, large, monkeypatch):
    monkeypatch.setattr(substrings, "LARGE_BUCKET", large)
    random.seed(large)
    word = lambda: "".join(random.choice("abcdef") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)] + [["same"] * 700]
    texts = [None, "", "short text"]
    for _ in range(40):
        parts = [[word() for _ in range(random.randint(0, 60))] for _ in range(3)]
        parts.insert(1, random.choice(passages))
        parts.insert(3, random.choice(passages))
        texts.append(" ".join(w for p in parts for w in p))
    texts += texts[5:8]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.kept_words(documents(texts)).collect()}
    assert got == brute_kept(list(enumerate(texts)))
    assert got[len(texts) - 1][1] > 0


def test_passages_edge_rows(documents):
    long = " ".join(f"w{k}" for k in range(60))
    assert substrings.kept_words(documents([])).count() == 0
    rows = substrings.kept_words(documents([long, long, long, long], ids=[3, 3, None, 4])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (3, 0), (3, 0), (4, 60)]


def test_sliding_minimum():
    rng = np.random.default_rng(2)
    for n, width in ((1, 1), (43, 43), (100, 43), (129, 43), (200, 7)):
        v = rng.integers(0, 1000, n).astype(np.uint64)
        assert substrings._sliding_minimum(v, width).tolist() == [min(v[k : k + width]) for k in range(n - width + 1)]


def test_planted_benchmark_items(spark, documents):
    random.seed(12)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: random.choice(common) if random.random() < 0.4 else "".join(random.choice("abcdefghij") for _ in range(5))
    items = [" ".join(word() for _ in range(random.randint(16, 60))) for _ in range(30)]
    items[0] += " Answer: fortytwo"
    text = lambda n: " ".join(word() for _ in range(n))
    texts, want = [], set()
    for k in range(120):
        if k % 3:
            texts.append(text(random.randint(0, 300)))
            continue
        planted = items[k // 4].split()
        if k % 2:  # a paraphrase: a sixth of the words changed
            planted = [word() if j % 6 == 3 else w for j, w in enumerate(planted)]
        texts.append(f"{text(random.randint(0, 200))} {' '.join(planted)}, {text(40)}")
        want.add((k, k // 4))
    docs = documents([*texts, None, "", items[0].rsplit(" Answer", 1)[0]])
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.coverage >= decontaminate.COVERAGE for r in rows)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(documents([]), bench).count() == 0


def test_long_benchmark_items(spark, documents):
    """Items of several parts: the last words alone are no match, the whole item is, also far from its answer."""
    random.seed(21)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    sizes = (257, 300, 300, 129, 700)
    items = [[word() for _ in range(n)] for n in sizes]
    items[2] = [*items[2][:-2], "Answer:", "forty", "two"]
    text = lambda n: [word() for _ in range(n)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for tail in (1, 2, 44, len(item) // 2):  # clean: only the last words of the item
            texts.append([*text(90), *item[-tail:], *text(90)])
        for before in (0, 75, 400):
            want |= {(len(texts), k), (len(texts) + 1, k)}
            texts.append([*text(before), *item, *text(60)])
            changed = [w if j % 4 or w in ("forty", "two") else word() for j, w in enumerate(item)]
            texts.append([*text(before), *changed, *text(60)])
    texts.append([*text(50), *items[2][:-2], *text(300)])  # without the answer
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(documents([" ".join(x) for x in texts]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(decontaminate.COVERAGE <= r.coverage <= 1 for r in rows)


def planted(seed, items, sizes, changed, vocabulary=4000):
    """Texts that hold one item each with a share of its words changed, and the items; words are seldom and common."""
    rng = np.random.default_rng(seed)
    words = np.array(["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(vocabulary)])
    share = 1 / np.arange(1, vocabulary + 1)
    draw = lambda n: rng.choice(words, n, p=share / share.sum())
    bench, texts = [], []
    for _ in range(items):
        item = draw(rng.integers(*sizes))
        copy = item.copy()
        at = rng.choice(item.size, round(changed * item.size), replace=False)
        copy[at] = draw(at.size)
        bench.append(" ".join(item))
        texts.append(" ".join([*draw(rng.integers(0, 120)), *copy, *draw(rng.integers(0, 120))]))
    return texts, bench


@pytest.mark.parametrize(("items", "sizes", "changed"), [(600, (6, 12), 0.2), (1500, (15, 60), 0.35)])
def test_recall_of_short_and_many_items(spark, documents, items, sizes, changed):
    texts, bench = planted(31, items, sizes, changed)
    rows = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(texts), rows).collect()}
    assert sum((k, k) in got for k in range(items)) >= 0.97 * items


def test_blocks_and_passes_lose_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "PARTS", 16)
    monkeypatch.setattr(decontaminate, "BLOCKS", 2)
    texts, bench = planted(32, 70, (6, 400), 0.0)
    rows = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = decontaminate.contaminated(documents(texts), rows).collect()
    assert {(k, k) for k in range(70)} <= {(r.doc_id, r.item_id) for r in got}
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)


def test_seldom_words_find_what_all_pairs_find():
    texts, bench = planted(33, 60, (6, 17), 0.2, vocabulary=300)
    block = decontaminate.block_of([(k, w, [], w) for k, w in enumerate(map(decontaminate.words_of, bench))])
    terms = decontaminate.united([block])
    found = [decontaminate.words_of(t) for t in texts]
    held = np.array([sum(w in set(x) for x in found) for w in block.terms])
    seldom = decontaminate.seldom_words([block], terms, [(held, None, len(found))])
    number, run, first = decontaminate.term_runs(found, terms.numbers)
    got = set(zip(*(x.tolist() for x in seldom.candidates(number, run, first)), strict=True))
    inverse, want = decontaminate.inverse_frequency(held, len(found)), set()
    for d, text in enumerate(found):
        for p in range(first[d + 1] - first[d]):
            passage = set(text[p * decontaminate.STEP :][: decontaminate.PASSAGE])
            for k, item in enumerate(block.items):
                weight = [inverse[block.terms[w]] ** 2 for w in item]
                there = [w in passage for w in item]
                enough = np.dot(weight, there) / sum(weight) >= decontaminate.REACH * decontaminate.COVERAGE
                if enough and sum(there) / len(item) >= decontaminate.COVERAGE:
                    want.add((int(first[d]) + p, k))
    assert got == want and len(want) >= 50


def test_common_length():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    random.seed(3)
    for _ in range(200):
        a, b = ([random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 12))] for _ in range(2))
        assert decontaminate.common_length(a, b) == brute(a, b)


def brute_nearest(rows, k, every=20):
    out = set()
    for q, v in rows:
        if q % every == 0:
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)[:k]
            out |= {(q, i) for _, i in near}
    return out


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 16))
    rows = [(k, (centres[k % 10] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(1000)]
    rows[41] = (41, rows[40][1])
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame).collect()
    want = brute_nearest(rows, 20)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & want) >= 0.9 * len(want) and len(got) == len(want)
    by = dict(rows)
    for r in got:
        assert r.score == pytest.approx(float(np.dot(np.float64(by[r.query_id]), np.float64(by[r.vec_id]))), abs=1e-12)
    for q in {r.query_id for r in got}:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda x: (-x[1], x[2]))


def test_block_search_equals_brute_force_where_it_looks(monkeypatch):
    """Copies of one vector, equal scores and repeated ids; with a stop that never holds all rows are verified."""
    monkeypatch.setattr(neighbours, "LEAF", 5)
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(size=(150, 12)), np.repeat(rng.normal(size=(1, 12)), 60, axis=0), np.eye(12)])
    ids = rng.permutation(len(vectors)).astype(np.int64)
    ids[5] = ids[9]
    longest = float(np.sqrt((vectors**2).sum(1).max()))
    shard = neighbours.Shard(ids, vectors, longest)
    shard.stop = np.inf
    asked = np.concatenate([np.arange(0, 30), np.arange(150, 160), [200]])
    query, found, score = shard.nearest(ids[asked], vectors[asked], 7)
    for at, row in enumerate(asked):
        scores = np.einsum("ij,ij->i", np.repeat(vectors[row][None], len(vectors), axis=0), vectors)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[row])[:7]
        got = [(-s, i) for q, i, s in zip(query.tolist(), found.tolist(), score.tolist()) if q == at]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


@pytest.mark.parametrize("together", [1, 3, 7, 512])
def test_every_query_is_answered(spark, monkeypatch, together):
    """More queries than are searched at once, over several shards and blocks."""
    for name, value in (("TOGETHER", together), ("SHARD_ROWS", 90), ("QUERY_ROWS", 20)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(400)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=5).collect()
    want = brute_nearest(rows, 20, every=5)
    assert {r.query_id for r in got} == set(range(0, 400, 5)) and len(got) == len(want) == 80 * 20
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_repeated_and_long_ids_of_vectors(spark, monkeypatch):
    """Repeated rows count once, a repeated query id takes its smallest vector, other lengths are no candidates."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 2)
    schema = "vec_id long, embedding array<float>"
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 0.0, 0.0]), (2**62, [3.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(20, 1, 1, 3.0), (20, 2, 2, 3.0), (20, 3, 2**62, 3.0)]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    rows = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], schema)).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in rows) == [(1, 1, 2.0), (2, 2, 2.0)]
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0])], schema)).count() == 0
    assert abs(neighbours.chi_square_tail(neighbours.stop_factor(), neighbours.AXES) - neighbours.MISS) < 1e-6
