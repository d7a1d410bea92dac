"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

The method. Entries become integers (floor of 1024 times the entry, plus 100,000). A first aggregate counts the vectors and
sums each dimension; a second one sums the products of the entries less their rounded mean. Both are sums of integers, so
they are exact and the same however rows are dealt out; the rest of the centring is an exact correction. The scatter A is
then a d x d matrix: A = G G' by Cholesky with the largest remaining pivot first, and plane rotations from the right make the
columns of G orthogonal (G J = U S, so A = U S^2 U'). Squared column norms are eigenvalues, unit columns are components;
A itself is never iterated on, so small eigenvalues keep their digits. A last pass projects the rows.

What is sent: d + 1 sums and d * (d + 1) / 2 products to the driver, each task having summed its own rows first, and at most
d x d numbers to the tasks. The measured covariance of the whitened rows comes from those rows as written.

Defined results: vectors that are null, empty, hold a null or non-finite entry, or an entry beyond 2^42 (whose integer is
not exact in a double) are left out, as are vectors of another length than most have (ties: the longer); repeated rows and
ids count as they stand; a null id stays null; other columns are not read. Directions without variance (all vectors equal,
or dimensions that depend on others) have no component: there are as many as the scatter has rank, at most the number asked
for. A squared deviation beyond the range of a long is null. A table without a usable vector gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.storage import save, small_batches

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 42)


@dataclass
class Model:
    n: int
    sums: list[int]  # of each dimension
    components: np.ndarray  # d x k, unit columns
    eigenvalues: np.ndarray  # of the covariance, falling
    trace: float  # of the covariance


def usable(vector: str):
    """Vectors with entries, none of them null, non-finite or too large."""
    c = F.col(vector)
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False))), F.lit(False))


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as integers."""
    flat = column.flatten().to_numpy().astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _products(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z' w of integers, exact: in doubles where all sums fit their mantissa, else in whole numbers of any size."""
    most = int(np.abs(z).max(initial=0)) * int(np.abs(w).max(initial=0)) * len(z)
    if most < 1 << 53:
        return (z.T.astype(np.float64) @ w.astype(np.float64)).astype(np.int64).astype(object)
    return z.T.astype(object) @ w.astype(object)


def _summed(vectors: DataFrame, terms) -> dict[int, list[int]]:
    """For each length of vectors the sums of the integers that terms makes of a batch, added in each task before the shuffle."""
    schema = pa.schema([("d", pa.int32()), ("k", pa.int32()), ("s", pa.decimal128(38, 0))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            length = pc.list_value_length(batch.column(0)).to_numpy()
            for d in np.unique(length).tolist():
                part = terms(_integers(batch.column(0).filter(pa.array(length == d))))
                total[d] = part + total.get(d, 0)
        for d, sums in total.items():
            yield pa.record_batch([pa.array([d] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array([Decimal(int(x)) for x in sums], pa.decimal128(38, 0))], schema=schema)

    found = vectors.select("v").mapInArrow(add, "d int, k int, s decimal(38,0)").groupBy("d", "k").agg(F.sum("s").alias("s"))
    out: dict[int, list[int]] = {}
    for d, _, s in sorted(map(tuple, found.collect())):  # as many as there are terms
        out.setdefault(d, []).append(int(s))
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with G G' = a, its columns in the order of the largest remaining pivots; as many as the rank.

    A dimension is spent when what others leave of its own variance is no more than rounding.
    """
    d = len(a)
    left, g, rest = a.astype(np.float64).copy(), np.zeros((d, d)), np.arange(d)
    least = d * np.finfo(np.float64).eps * a.diagonal()
    for k in range(d):
        rest = rest[left.diagonal()[rest] > least[rest]]
        if not len(rest):
            return g[:, :k]
        p = rest[np.argmax(left.diagonal()[rest])]
        g[rest, k] = left[rest, p] / np.sqrt(left[p, p])
        rest = rest[rest != p]
        left[np.ix_(rest, rest)] -= np.outer(g[rest, k], g[rest, k])
    return g


def one_sided_jacobi(g: np.ndarray, max_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms squared, unit columns) of g after plane rotations of its columns until all are orthogonal; norms fall."""
    g = g.copy()
    r, least = g.shape[1], max(4, len(g)) * np.finfo(np.float64).eps  # what rounding leaves of a product of orthogonal columns
    for _ in range(max_sweeps):
        turned = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                x, y = g[:, p], g[:, q]
                a, b, c = x @ x, y @ y, x @ y
                if abs(c) <= least * np.sqrt(a * b):
                    continue
                turned = True
                t = (b - a) / (2 * c)
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                cos = 1 / np.hypot(1.0, t)
                g[:, p], g[:, q] = cos * (x - t * y), cos * (y + t * x)
        if not turned:
            break
    else:
        raise RuntimeError("the rotations didn't settle")
    norms = (g * g).sum(0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], g[:, order] / np.sqrt(norms[order])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of vectors(v), of those with the length that most have; None without rows."""
    by_length = _summed(vectors, lambda x: np.append(x.sum(0).astype(object), len(x)))
    if not by_length:
        return None
    d = max(by_length, key=lambda x: (by_length[x][-1], x))
    n, sums = by_length[d][-1], by_length[d][:-1]
    middle = _middle(n, sums)
    i, j = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        z = x - middle
        return _products(z, z)[i, j]

    found = _summed(vectors.where(F.size("v") == d), products)[d]
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    # n times the centred scatter, exact; scaled before it becomes a matrix of doubles
    exact = [n * s - rest[a] * rest[b] for s, a, b in zip(found, i.tolist(), j.tolist(), strict=True)]
    cov = np.zeros((d, d))
    cov[i, j] = cov[j, i] = [x / (n * n) for x in exact]
    norms, unit = one_sided_jacobi(pivoted_cholesky(cov))
    k = min(components, len(norms))
    return Model(n, sums, unit[:, :k], norms[:k], float(np.trace(cov)))


def _middle(n: int, sums: list[int]) -> np.ndarray:
    """Means, rounded to whole numbers."""
    return np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)


def _projected(vectors: DataFrame, m: Model) -> DataFrame:
    """(id, deviation, y): the exact squared deviation times n^2 and the whitened coordinates."""
    n, sums, d = m.n, m.sums, len(m.sums)
    middle = _middle(n, sums)
    rest = np.array([s - n * int(c) for s, c in zip(sums, middle, strict=True)], object)  # n x - S = n (x - middle) - rest
    offset = np.array([float(x) for x in rest]) / n
    onto = m.components / np.sqrt(m.eigenvalues)
    schema = pa.schema([("id", pa.int64()), ("deviation", pa.int64()), ("y", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _integers(batch.column(1)) - middle
            most = n * int(np.abs(z).max()) + n
            if d * most * most < 1 << 63:
                u = n * z - rest.astype(np.int64)
                deviation = (u * u).sum(1).tolist()
            else:
                deviation = [s if (s := sum(v * v for v in u)) < 1 << 63 else None for u in (n * z.astype(object) - rest).tolist()]
            y = (z - offset) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(deviation, pa.int64()), lists], schema=schema)

    return vectors.select("id", "v").mapInArrow(project, "id long, deviation long, y array<double>")


def _identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, measured on the rows."""
    i, j = np.triu_indices(k)

    def moments(terms):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + terms(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1))
            if isinstance(total, np.ndarray):
                yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "s"])

        got = rows.select("y").mapInArrow(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        return np.array([s for _, s in sorted(map(tuple, got))]) / n

    mean = moments(lambda y: y.sum(0))
    return float(np.abs(moments(lambda y: ((y - mean).T @ (y - mean))[i, j]) - (i == j)).max())


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[Model | None, DataFrame]:
    """The fitted model and (id, deviation, y) of each usable vector: y holds its whitened coordinates, the first component first."""
    small_batches(vectors.sparkSession)
    kept = vectors.where(usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    model = fit(kept, components)
    if model is None:
        return None, kept.sparkSession.createDataFrame([], "id long, deviation long, y array<double>")
    return model, _projected(kept.where(F.size("v") == len(model.sums)), model)


def whitening(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component from 1, n, deviation, whitened, explained, identity_error."""
    model, rows = whitened(vectors, id, vector, components)
    k = len(model.eigenvalues) if model else 0
    shares, error = [], 0.0
    if k:
        rows = save(rows, "whitened")
        shares, error = (model.eigenvalues / model.trace).tolist(), _identity_error(rows, model.n, k)
    else:
        rows = rows.limit(0)  # no vector, or no direction in which vectors differ
    each = rows.select("id", "deviation", F.posexplode("y").alias("place", "whitened"))
    share = F.array(*[F.lit(float(x)) for x in shares or [0.0]])
    return each.select(
        F.col("id").alias(id), (F.col("place") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
