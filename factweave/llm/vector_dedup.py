"""Near copies among embeddings: codes by iterative quantisation, multi-index Hamming tables, reranking by true cosines.

The method. A rotation of the principal axes is learned on a sample so that the signs of the rotated coordinates are as near
to the coordinates as they can be (alternating between signs and the best orthogonal map): balanced binary codes of 64 bits,
from several rotations where vectors have fewer dimensions. The code is cut into eight blocks; each pair of blocks is a table,
so a code stands in 28 tables under 16 of its bits. Two codes meet in the tables of the blocks that they share, and count in
one of them only: that of their first two equal blocks, which both codes tell. In a table, codes within a Hamming radius
keep their place, their vectors are fetched, and cosines of all pairs in that place are computed in double precision.

Recall. A link is lost only if its codes share fewer than two blocks or differ in more than RADIUS bits. At a cosine of 0.98
one bit in sixteen differs where directions are random, and 99 of 100 such pairs share two blocks; closer pairs
differ less. No link is made from codes alone, so none is below the asked cosine.

How it is dealt out. Equal vectors are one class, classes of one code are one entry of the tables. Places are cut into pieces
that meet pairwise. A task gives each vector's number of links and the root of its piece of the link graph, never
the pairs, so what it writes grows with the vectors, while a group of g near copies costs g * g / 2 cosines inside tasks.

Defined results: a vector is usable if it isn't null, empty or zero, all entries are finite, and label and id are not null;
all others link with nothing. Vectors of different lengths never link; for their codes, vectors longer than most are folded
and shorter ones filled up with zeros. Each row is a vector of its own, repeated ids too: n_links counts rows. Equal
vectors (by 128-bit fingerprint) link. component_id is the smallest id reachable (a null id stays null and is kept). Other columns are
not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import connected_components
from factweave.llm.storage import save, small_batches

LEAST = 0.98
BITS, BLOCKS = 64, 8
RADIUS = 12
#: Vectors that the rotation is learned on, chosen by the hash of their ids; all vectors are indexed.
SAMPLE = 20_000
#: Codes and vectors of a place that meet in one task; larger places are cut.
CODE_BLOCK, VECTOR_BLOCK = 4096, 1024
#: Pairs of rows looked at together, rows of places read together, and places from which on cosines are a matrix product.
PAIRS_AT_ONCE, ROWS_AT_ONCE, PRODUCT_FROM = 1 << 18, 4096, 48

_WIDTH = BITS // BLOCKS
TABLES = list(combinations(range(BLOCKS), 2))
_MASKS = [sum(((1 << _WIDTH) - 1) << (_WIDTH * b) for b in t) for t in TABLES]
#: Table in which a pair counts, by the set of its equal blocks; -1 for fewer than two.
_TABLE_OF = np.array([next((k for k, t in enumerate(TABLES) if all(e >> b & 1 for b in t)), -1) for e in range(1 << BLOCKS)], np.int8)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, scaled to length 1 in double precision."""
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _folded(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors of any lengths as rows of d numbers."""
    length = pc.list_value_length(column).to_numpy()
    out = np.zeros((len(column), d))
    for n in np.unique(length).tolist():
        x = _unit(column.filter(pa.array(length == n)))
        x = np.pad(x, ((0, 0), (0, -n % d)))
        out[length == n] = x.reshape(len(x), -1, d).sum(1)
    return out


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 20_240) -> tuple[np.ndarray, np.ndarray]:
    """(mean, d x bits map): signs of (x - mean) @ map are the codes. Rows of x are the sample."""
    mean, d = x.mean(0), x.shape[1]
    z = x - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    parts, rng = [], np.random.default_rng(seed)
    while sum(p.shape[1] for p in parts) < bits:
        use = axes[:, : min(bits, d)]
        v = z @ use
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(use @ r)
    return mean, np.concatenate(parts, 1)[:, :bits]


def codes_of(x: np.ndarray, mean: np.ndarray, onto: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ onto > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def _fitted(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    lengths = vectors.groupBy(F.size("v").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["count"]
    part = vectors.where((F.size("v") == d) & (F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / n) * (1 << 40))))
    x = part.dropDuplicates(["f1", "f2"]).select("f1", "v").toArrow()  # SAMPLE rows on average
    if not x.num_rows:  # a few rows, none chosen
        x = vectors.where(F.size("v") == d).limit(1).select("f1", "v").toArrow()
    return learn_rotation(_unit(x.sort_by("f1")["v"].combine_chunks()))


def _coded(vectors: DataFrame, mean: np.ndarray, onto: np.ndarray) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("d", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("code", pa.int64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = codes_of(_folded(batch.column(5), len(mean)), mean, onto).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got)], schema=schema)

    return vectors.select("id", "label", F.size("v").alias("d"), "f1", "f2", "v").mapInArrow(code, "id long, label string, d int, f1 long, f2 long, code long")


def _pieces(rows: DataFrame, key: list[str], member: str, block: int) -> DataFrame:
    """rows with p, q and far: places of more than block rows are cut into pieces that meet pairwise.

    Any two rows of a place meet once: where p = q within a piece, else across (far tells the two pieces apart).
    """
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block)
    parts = F.ceil(F.coalesce("held", F.lit(1)) / block).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("piece", o).alias("p"), F.greatest("piece", o).alias("q")))
    cut = rows.join(large, key, "left").withColumn("parts", parts).withColumn("piece", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    cut = cut.select(*rows.columns, "piece", F.inline(meet))
    return cut.select(*rows.columns, "p", "q", ((F.col("p") < F.col("q")) & (F.col("piece") == F.col("q"))).alias("far"))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL)


def whole_places(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by keys -> tables of whole groups of equal keys, several groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = _starts([batch[k] for k in keys])
        start[0] = not held or any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys)
        cut = int(np.flatnonzero(start)[-1]) if start.any() else -1
        if cut >= 0 and sum(x.num_rows for x in held) + cut >= ROWS_AT_ONCE:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(columns: list) -> np.ndarray:
    """Where a sorted group begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy(zero_copy_only=False)
    return new


def _pairs(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i < j in groups begin <= i, j < end, some at once."""
    size = end - begin
    i = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(end, size) - i - 1
    total = np.cumsum(after)
    for a in range(0, int(total[-1]) if len(total) else 0, PAIRS_AT_ONCE):
        flat = np.arange(a, min(a + PAIRS_AT_ONCE, int(total[-1])))
        k = np.searchsorted(total, flat, side="right")
        yield i[k], i[k] + 1 + flat - (total[k] - after[k])


def _counts_here(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether pairs of codes with differing bits x count in these tables; -1 is the table of equal codes."""
    equal = np.zeros(x.shape, np.uint8)
    for b in range(BLOCKS):
        equal |= ((x >> np.uint64(_WIDTH * b)) & np.uint64((1 << _WIDTH) - 1) == 0).astype(np.uint8) << np.uint8(b)
    return np.where(x == 0, -1, _TABLE_OF[equal]) == np.where((x != 0) & (table == -1), -2, table)


_PLACE = ["label", "d", "t", "key"]
_CELL = [*_PLACE, "p", "q"]


def _near_codes(radius: int):
    """Places of codes -> the codes of each that have another one within the radius which counts there."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_places(batches, _CELL):
            begin = np.flatnonzero(_starts([t[k] for k in _CELL]))
            code, table = t["code"].to_numpy().view(np.uint64), t["t"].to_numpy()
            far, cross = t["far"].to_numpy(), t["p"].to_numpy() < t["q"].to_numpy()
            found = np.zeros(len(code), bool)
            for i, j in _pairs(begin, np.append(begin[1:], len(code))):
                x = code[i] ^ code[j]
                ok = (np.bitwise_count(x) <= radius) & (~cross[i] | (far[i] != far[j]))
                i, j, x = i[ok], j[ok], x[ok]
                ok = _counts_here(x, table[i])
                found[i[ok]] = found[j[ok]] = True
            yield from t.select([*_PLACE, "code"]).filter(pa.array(found)).to_batches()
    return near


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j in root, where each node points to its root."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _links(least: float):
    """Places of vectors -> (c, n, root): rows that each class links with there, and a class that it is connected with."""
    schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def link(t: pa.Table) -> pa.RecordBatch:
        begin = np.flatnonzero(_starts([t[k] for k in _CELL]))
        end = np.append(begin[1:], t.num_rows)
        v, c, m = _unit(t["v"].combine_chunks()), t["c"].to_numpy(), t["m"].to_numpy()
        code, table = t["code"].to_numpy().view(np.uint64), t["t"].to_numpy()
        far, cross = t["far"].to_numpy(), t["p"].to_numpy() < t["q"].to_numpy()
        n, root = np.zeros(len(c), np.int64), np.arange(len(c))

        def take(i: np.ndarray, j: np.ndarray) -> None:
            ok = (~cross[i] | (far[i] != far[j])) & _counts_here(code[i] ^ code[j], table[i])
            i, j = i[ok], j[ok]
            np.add.at(n, i, m[j])
            np.add.at(n, j, m[i])
            _union(root, i, j)

        large = end - begin >= PRODUCT_FROM
        for i, j in _pairs(begin[~large], end[~large]):
            ok = np.concatenate([(v[i[s]] * v[j[s]]).sum(1) >= least for s in np.array_split(np.arange(len(i)), len(i) // 8192 + 1)])
            take(i[ok], j[ok])
        for a, b in zip(begin[large].tolist(), end[large].tolist(), strict=True):
            for s in range(a, b, 256):
                i, j = np.nonzero(v[s : min(s + 256, b)] @ v[s:b].T >= least)
                take(s + i[j > i], s + j[j > i])
        hit = n > 0
        return pa.record_batch([pa.array(c[hit]), pa.array(n[hit]), pa.array(c[root[hit]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_places(batches, _CELL):
            for d in pc.unique(t["d"]).to_pylist():  # vectors of one length at a time
                yield link(t.filter(pc.equal(t["d"], d)))
    return run


def _usable(vector: str) -> Column:
    c = F.col(vector)
    finite = F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(c, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id, kept (no smaller id is in its component)."""
    small_batches(vectors.sparkSession)
    read = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable("v")
    usable = read.where(good).withColumn("f1", F.xxhash64("v")).withColumn("f2", F.xxhash64(F.lit("second"), "v"))
    fitted = _fitted(usable)
    rest = read.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if fitted is not None:
        rest = _grouped(usable, fitted, least, radius).union(rest)
    return rest.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _grouped(usable: DataFrame, fitted: tuple[np.ndarray, np.ndarray], least: float, radius: int) -> DataFrame:
    """(id, n_links, component_id) of each usable vector."""
    same = ["label", "d", "f1", "f2"]
    coded = save(_coded(usable, *fitted), "coded")
    classes = coded.groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"), F.min("code").alias("code"))
    classes = save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written: the numbers stay
    codes = save(classes.groupBy("label", "d", "code").agg(F.count(F.lit(1)).alias("m")), "codes")
    tables = F.array(*[F.struct(F.lit(k).cast("byte").alias("t"), F.col("code").bitwiseAND(F.lit(_signed(x))).alias("key")) for k, x in enumerate(_MASKS)])
    entries = codes.select("label", "d", "code", F.inline(tables))
    near = _together(_pieces(entries, _PLACE, "code", CODE_BLOCK)).select(*_CELL, "code", "far").mapInArrow(_near_codes(radius), "label string, d int, t byte, key long, code long").distinct()
    alone = codes.where("m > 1").select("label", "d", F.lit(-1).cast("byte").alias("t"), F.col("code").alias("key"), "code")
    places = save(near.unionByName(alone), "places")
    members = save(places.join(classes.select("label", "d", "code", "c", "m"), ["label", "d", "code"]), "members")
    fetched = usable.withColumn("d", F.size("v")).select("id", *same, "v").join(_wanted(members, classes), [*same, "id"]).dropDuplicates(["id", *same]).select("c", "v")
    rows = _pieces(members, _PLACE, "c", VECTOR_BLOCK).join(save(fetched, "vectors"), "c")
    links = save(_together(rows).select(*_CELL, "far", "c", "m", "code", "v").mapInArrow(_links(least), "c long, n long, root long"), "links")
    degree = links.groupBy("c").agg(F.sum("n").alias("n"))
    component = connected_components(links.select(F.col("c").alias("a"), F.col("root").alias("b")))
    component = component.join(classes.select(F.col("c").alias("node"), "first"), "node")
    least_id = component.groupBy("component").agg(F.min("first").alias("component_id"))
    component = component.join(least_id, "component").select(F.col("node").alias("c"), "component_id")
    told = classes.join(degree, "c", "left").join(component, "c", "left")
    told = told.select(*same, (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    return coded.select("id", *same).join(save(told, "told"), same).select("id", "n_links", "component_id")


def _wanted(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes whose vectors are compared, with the id of one row of each."""
    return classes.join(members.select("c").distinct(), "c", "left_semi").select("label", "d", "f1", "f2", F.col("first").alias("id"), "c")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
