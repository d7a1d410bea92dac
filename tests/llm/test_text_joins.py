"""Similarity join, substring removal and components against brute force."""

import random

import numpy as np
import pytest

from factweave.llm import shingle_join
from factweave.llm import words as W
from factweave.llm.components import connected_components
from factweave.llm.shingle_join import link_counts, one_of_each, r_tree_pairs, similar_groups
from factweave.llm.substring_dedup import substring_dedup
from tests.llm.brute import components, dedup, shingles

SCHEMA = "doc_id long, text string, token string, n long"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéÄ", k=rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(12)]
    shared = [word() for _ in range(45)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n\x0b "), (203, "one two"), (204, "ONE  two"), (205, "a b c d e"), (206, "same " * 300), (207, "same " * 290)]
    return rows + [rows[3], (None, rows[0][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in corpus()], SCHEMA).repartition(5).cache()


def test_similar_groups(docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(docs).collect()), key=str)
    assert got == components(corpus())


def test_one_of_each_keeps_one_row_a_group(docs):
    left = sorted(r.doc_id for r in one_of_each(docs).where("doc_id IS NOT NULL").collect())
    assert left == sorted({c for _, _, c in components(corpus()) if c is not None}) and one_of_each(docs).columns == docs.columns


def test_different_texts_under_one_id_stay(spark):
    long = lambda seed: " ".join(f"{seed}{i}" for i in range(30))
    rows = [(5, long("x")), (5, long("y")), (7, long("y") + " end"), (9, long("x") + " end"), (9, long("z")), (9, long("z")), (11, long("z"))]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    left = [(r.doc_id, r.text) for r in got.collect()]
    texts = sorted(t for _, t in left)
    assert len(left) == 3 and [t[0] for t in texts] == ["x", "y", "z"] and (5, long("x")) in left


def test_other_text_of_a_copied_id_keeps_its_links(spark):
    long = lambda seed: " ".join(f"{seed}{i}" for i in range(30))
    rows = [(1, long("x")), (2, long("x")), (2, long("y")), (3, long("y") + " end")]
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("bits", [4, 18])
def test_fine_points_bound_the_overlap(monkeypatch, bits):
    monkeypatch.setattr(shingle_join, "MID_BITS", bits)
    monkeypatch.setattr(shingle_join, "MID_FROM", 0)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(60)]
    sets += [np.sort(pool[:40] >> np.uint64(50)), np.sort(pool[10:60] >> np.uint64(50))]  # all in one group
    mids = shingle_join._fine_points(sets)[0].to_pylist()
    i, j = np.triu_indices(len(sets), 1)
    bound = shingle_join._mid_bound(mids, i, j)
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (bound >= true).all()
    if bits == 18:
        assert np.median(bound - true) <= 24  # of up to 300 shingles, most of them not shared


def test_search_rows_grow_in_proportion(spark):
    """A group of near copies and of texts just below the similarity, five times as large: five times the candidates, not 25."""
    rng, made = random.Random(8), []
    for size in (120, 600):
        base = [f"w{i}" for i in range(150)]
        rows = []
        for i in range(size):
            w = list(base)
            for at in rng.sample(range(150), 1 if i % 4 else 9):
                w[at] = f"x{i}_{at}"
            rows.append((i, " ".join(w)))
        made.append(0)
        found = shingle_join._search

        def counted(percent, found=found, total=spark.sparkContext.accumulator(0)):
            counted.total = total

            def search(batches):
                for b in found(percent)(batches):
                    total.add(b.num_rows)
                    yield b
            return search

        shingle_join._search = counted
        try:
            got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
        finally:
            shingle_join._search = found
        made[-1] = counted.total.value
        if size == 120:
            assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows)
    assert made[1] <= 12 * max(made[0], 20)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == components(rows)


def test_link_counts(spark):
    rows = [x for x in dict(corpus()).items() if x[0] is not None]
    sets = {d: shingles(t) for d, t in rows}
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    want = {d: sum(e != d and linked(x, y) for e, y in sets.items()) for d, x in sets.items()}
    counts, pairs = link_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.n_links for r in counts.collect()} == want and max(want.values()) > 5
    firsts = {min(e for e, y in sets.items() if x == y) for x in sets.values() if x}
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in firsts for b in firsts if a < b and linked(sets[a], sets[b])}


def test_blocks_cut_into_pieces(docs, monkeypatch):
    import factweave.llm.shingle_join as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 3)
    monkeypatch.setattr(module, "FREQUENT", 1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(docs).collect()), key=str)
    assert got == components(corpus())


def test_r_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    n = 700
    points = rng.poisson(rng.choice([0.1, 0.4], (n, 1)), (n, 256)).astype(np.uint16)
    points[rng.integers(0, n, 200)] = points[rng.integers(0, n, 200)]
    size, block, group = points.sum(1).astype(np.int64) + 1, np.sort(rng.integers(0, 4, n)), rng.integers(0, 60, n)
    i, j = r_tree_pairs(block, np.full(n, -1), size, group, points, 75)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            if block[a] == block[b] and group[a] != group[b]:
                x, y = int(size[a]), int(size[b])
                if 100 * x >= 75 * y and 100 * y >= 75 * x and 175 * int(np.minimum(points[a], points[b]).sum()) >= 75 * (x + y):
                    want.add((a, b))
    assert want and got == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(900, 901), (901, 900), (950, 950)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


@pytest.mark.parametrize("window", [8, 12, 35])
def test_substring_dedup(docs, window):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, window).collect()), key=str)
    assert got == dedup(corpus(), window)


def test_hot_anchors_are_dealt_out(docs, monkeypatch):
    import factweave.llm.substring_dedup as module

    monkeypatch.setattr(module, "HOT_IN_CHUNK", 1)
    monkeypatch.setattr(module, "HOT_IN_ALL", 1)
    assert len(module.hot_anchors(docs, 12)) > 100
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, 12).collect()), key=str)
    assert got == dedup(corpus(), 12)


def test_different_windows_that_agree_in_half_their_hash(spark):
    head = [f"h{i}" for i in range(34)]
    last = [f"x{i}" for i in range(300_000)]
    data = np.frombuffer(" ".join(head + last).encode(), np.uint8)
    h, up = W.split(data, np.array([0, len(data)]), slice(0, 1)).hashes, W._power_tables(35)[0]
    low = W.mix((h[:34] * up[:34]).sum(dtype=np.uint64) + h[34:] * up[34]) & np.uint64(2**32 - 1)
    order = np.argsort(low)
    same = np.flatnonzero(np.diff(low[order]) == 0)
    rows = [(int(k), " ".join([*head, last[k]])) for k in sorted({*order[same].tolist(), *order[same + 1].tolist()})]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))).collect()
    assert len(rows) >= 8 and len(got) == len(rows) and {r.n_removed for r in got} == {0}


def test_removed_spans_are_maximal(docs):
    for r in substring_dedup(docs, 12).collect():
        assert sum(b - a for a, b in r.removed) == r.n_removed and all(x[1] < y[0] for x, y in zip(r.removed, r.removed[1:]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similar_groups(none).count() == substring_dedup(none).count() == one_of_each(none).count() == 0
