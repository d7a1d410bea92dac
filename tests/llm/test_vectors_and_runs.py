"""Whitening, near copies of vectors and periodic runs against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from factweave.llm import vector_dedup
from factweave.llm.periodic_runs import periodic_runs, runs_of
from factweave.llm.vector_dedup import learn_rotation, near_vectors
from factweave.llm.vector_queries import planted_periods
from factweave.llm.whitening import one_sided_jacobi, pivoted_cholesky, whitening
from tests.llm.brute import words

VECTORS = "vec_id long, embedding array<double>, label int, component string, c long"


def plain_runs(w, least=24, periods=3):
    """(start, length, period) of every run, by start, then period."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed=4):
    rng = random.Random(seed)
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            part = [rng.choice("abcdefg") for _ in range(rng.randint(1, 12))]
            w += (part * rng.randint(1, 9))[: rng.randint(1, 90)]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200, None), (201, ""), (202, "  \n\x0b"), (203, "one"), (204, "é ß " * 40), (205, "x " * 23), (206, "x " * 24), (None, "a b " * 30), (7, rows[7][1]), (7, rows[7][1])]
    # equal exponents at two places, and two runs that share words
    rows += [(300, " ".join(["a", "b"] * 12 + list("tuvwxyz") + ["c", "d"] * 12)), (301, " ".join(["a"] * 30 + ["b"] + (["a"] * 12 + ["b"]) * 4))]
    return rows


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(300):
        docs = [[rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 70))] for _ in range(3)]
        docs[0] += docs[0][:5] * 6
        least, periods = rng.choice([(2, 2), (6, 3), (24, 3), (9, 4)])
        row = np.array([r for r, w in enumerate(docs) for _ in w], np.int64)
        got = runs_of(row, np.array([x for w in docs for x in w], np.uint64), least, periods)
        first = np.cumsum([0] + [len(w) for w in docs])
        assert sorted((r, a - first[r], b - a, q) for r, a, b, q in got.tolist()) == sorted((r, *x) for r, w in enumerate(docs) for x in plain_runs(w, least, periods))


def test_thue_morse_has_no_run():
    w = [bin(i).count("1") % 2 for i in range(4096)]
    assert not len(runs_of(np.zeros(4096, np.int64), np.array(w, np.uint64), 2, 3))


def test_periodic_runs(spark):
    rows = periodic_texts()
    docs = spark.createDataFrame([(d, t, "clash", 5) for d, t in rows], "doc_id long, text string, runs string, n_words int").repartition(4)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], tuple(r.greatest) if r.greatest else None, r.collapsed_text) for r in periodic_runs(docs).collect()), key=str)
    want = []
    for d, t in rows:
        w = words(t)
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want.append((d, len(w), runs, best, plain_collapsed(w, runs)))
    assert got == sorted(want, key=str) and sum(bool(x[2]) for x in want) > 30
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, 24, 1)


def test_runs_in_a_very_long_text(spark):
    rng = random.Random(2)
    noise = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    period = [f"p{i}" for i in range(9_000)]
    text = " ".join(noise[:60_000] + period * 5 + ["z"] * 40_000 + noise[60_000:])
    (r,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(60_000, 45_000, 9_000), (105_000, 40_000, 1)] and tuple(r.greatest) == (105_000, 40_000, 1)
    assert r.collapsed_text == " ".join(noise[:60_000] + period + ["z"] + noise[60_000:])


def test_planted_periods(spark):
    rows = [(d, " ".join(f"w{i}" for i in range(d % 90))) for d in range(300)] + [(None, "a b"), (10, None), (11, "")]
    got = {(r.doc_id, r.text) for r in planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, changed = set(), 0
    for d, t in rows:
        w, h = words(t), zlib.crc32(str(d).encode())
        g, n = h // 10, len(words(t))
        if d is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t, changed = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n)), changed + 1
        want.add((d, t))
    assert got == want and changed > 10


def plain_whitening(x, k=8):
    mean = x.mean(0)
    v = (x - mean).T @ (x - mean) / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (x - mean) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.2 + 0.3
    bad = [None, [], [None] + [0.0] * 11, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [-float("inf")] + [1.0] * 11, [1e300] * 12, [1.0] * 5]
    rows = [(i, v.tolist(), 1, "clash", 9) for i, v in enumerate(x)] + [(1000 + i, v, 1, None, None) for i, v in enumerate(bad)]
    rows += [rows[5], rows[5], (None, rows[6][1], None, None, None)]
    used = [r for r in rows if r[1] and len(r[1]) == 12 and all(v is not None and abs(v) < 1e12 for v in r[1])]
    whole = np.array([[int(np.floor(1024 * v)) + 100_000 for v in r[1]] for r in used])
    y, share = plain_whitening(whole.astype(float))
    s = whole.sum(0)
    want = sorted(((r[0], int(((len(used) * w - s) ** 2).sum()), z) for r, w, z in zip(used, whole, y, strict=True)), key=lambda t: (str(t[0]), t[1]))
    got = whitening(spark.createDataFrame(rows, VECTORS).repartition(6)).collect()
    assert len(got) == 8 * len(used) and {r.n for r in got} == {len(used)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(1, 9):
        mine = sorted(((r.vec_id, r.deviation, r.whitened, r.explained) for r in got if r.component == c), key=lambda t: (str(t[0]), t[1]))
        assert [t[:2] for t in mine] == [t[:2] for t in want]
        a, b = np.array([t[2] for t in mine]), np.array([t[2][c - 1] for t in want])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9 and abs(mine[0][3] / share[c - 1] - 1) < 1e-9


def test_whitening_without_full_rank(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(rows)], VECTORS)
    line = whitening(frame([[float(i), 2.0 * i, 0.0] for i in range(50)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 50 and abs(line[0].explained - 1) < 1e-12
    assert whitening(frame([[1.0, 2.0]] * 5)).count() == 0
    assert whitening(frame([])).count() == 0 and whitening(frame([None, [float("nan")]])).count() == 0
    far = whitening(frame([[1e12, 1.0], [-1e12, 1.0], [0.0, 2.0]])).collect()  # squared deviations beyond a long
    assert len(far) == 6 and {r.deviation is None for r in far} == {True, False} and far[0].identity_error < 1e-4


def test_factors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 9))
    a = a.T @ a * np.logspace(0, -12, 9)[:, None] * np.logspace(0, -12, 9)
    g = pivoted_cholesky(a)
    assert np.allclose(g @ g.T, a, rtol=1e-12, atol=1e-14)
    e, u = one_sided_jacobi(g)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12) and np.allclose((u * e) @ u.T, a, rtol=1e-10, atol=1e-13) and (np.diff(e) <= 0).all()
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0) and pivoted_cholesky(np.ones((4, 4))).shape == (4, 1)


def plain_near(rows, least=0.98):
    """[(id, n_links, component, kept)] of (id, vector, label) rows, each a vector of its own."""
    ok = [r[0] is not None and r[2] is not None and bool(r[1]) and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.abs(r[1]).max() / np.linalg.norm(np.array(r[1]) / np.abs(r[1]).max()) if g else None for r, g in zip(rows, ok, strict=True)]
    near = [{j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least} for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        c = min((rows[j][0] for j in seen), default=None) if r[0] is not None else None
        out.append((r[0], len(near[i]), c, r[0] is None or c == r[0]))
    return sorted(out, key=str)


def vectors(seed=6, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(14):  # chains and bunches around a few middles
        middle = rng.normal(size=d)
        for _ in range(rng.integers(1, 14)):
            rows.append((middle + rng.normal(size=d) * rng.choice([0.03, 0.1, 0.16])).tolist())
    rows += [rng.normal(size=d).tolist() for _ in range(80)]
    rows += [rows[0]] * 9 + [(np.array(rows[3]) * 1e-3).tolist(), (np.array(rows[3]) * -1).tolist(), (np.array(rows[3]) * 1e200).tolist()]
    rows = [(i, v, int(i % 7 == 0)) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * d, [None] + rows[1][1][1:], [float("nan")] * d, [float("inf")] + [0.0] * (d - 1)]
    rows += [(500 + i, v, 0) for i, v in enumerate(odd)] + [(600, rows[1][1], None), (None, rows[1][1], 0), rows[2], rows[2]]
    short = rng.normal(size=9).tolist()
    return rows + [(700, short, 0), (701, short, 0), (702, rng.normal(size=60).tolist(), 0)]


@pytest.mark.parametrize("block", [None, 7])
def test_near_vectors(spark, monkeypatch, block):
    if block:  # every larger place is cut into pieces
        monkeypatch.setattr(vector_dedup, "CODE_BLOCK", block)
        monkeypatch.setattr(vector_dedup, "VECTOR_BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS).repartition(5)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    want = plain_near(rows)
    assert [x[0] for x in got] == [x[0] for x in want] and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(x[1] for x in got) >= 0.99 * sum(x[1] for x in want) > 300
    if sum(x[1] for x in got) == sum(x[1] for x in want):
        assert got == want


def test_near_vectors_of_empty_tables(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    none = near_vectors(spark.createDataFrame([(1, None, 3, "x", 1), (2, [0.0], 3, "x", 1)], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in none) == [(1, 0, 1, True), (2, 0, 2, True)]
    one = near_vectors(spark.createDataFrame([(1, [1.0], 3, "x", 1), (2, [2.0], 3, "x", 1), (3, [-2.0], 3, "x", 1)], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in one) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_hot_group_writes_in_proportion(spark):
    """A group of near copies five times as large gives five times the rows, not its pairs."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=32)
    made = []
    for size in (300, 1500):
        v = middle + rng.normal(size=(size, 32)) * 0.02
        rows = [(i, x.tolist(), 1, "x", 0) for i, x in enumerate(v)] + [(10_000 + i, rng.normal(size=32).tolist(), 1, "x", 0) for i in range(300)]
        got = near_vectors(spark.createDataFrame(rows, VECTORS))
        assert got.where(f"vec_id < {size} AND n_links = {size - 1} AND component_id = 0").count() == size
        made.append(got.where("n_links > 0").count())
    assert made == [300, 1500]


def test_rotation_is_balanced():
    x = np.random.default_rng(0).normal(size=(3000, 40)) * np.linspace(3, 0.2, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, onto = learn_rotation(x)
    assert onto.shape == (40, 64) and abs(((x - mean) @ onto > 0).mean(0) - 0.5).max() < 0.1
    assert np.allclose(onto[:, :40].T @ onto[:, :40], np.eye(40), atol=1e-9)


def test_digests_of_the_query(spark, tmp_path):
    from factweave.llm.vector_queries import op12_periodic_runs

    rows = [(d, t) for d, t in periodic_texts() if d is not None and d != 7]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for r in op12_periodic_runs(spark, str(tmp_path)).collect():
        w = words(texts[r.doc_id])
        runs = plain_runs(w)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
        assert r.exponent_milli == (max(1000 * n // q for _, n, q in runs) if runs else None)
