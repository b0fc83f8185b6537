"""Embedding whitening: a compensated covariance over all rows, its eigenvectors, and every row projected on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Production parameters of op11: the contract's scale and shift, and how many components rows are projected on.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a slice and rows of a block: a product of two slices has at most 2 * (_BITS - 1) bits, a sum over a block
#: twelve more, so that every entry of a block's product is a whole number below 2^53 and exact in a double.
_BITS, _BLOCK = 20, 4096


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: their count, exact sums by dimension, and the leading components."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues by falling size, at most COMPONENTS
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    def spread(self) -> np.ndarray:
        """Components that vary at all; of the others the eigenvalue is rounding."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * 1e-15


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """-> (id, x array<long>): floor(scale * entry) + shift of the vectors that take part."""
    scaled = F.transform(F.col(vec_col), lambda v: v.cast("double") * scale)
    fine = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**62))
    out = vectors.select(F.col(id_col).cast("long").alias("_id"), scaled.alias("_x")).filter(F.col("_x").isNotNull() & fine & (F.size("_x") > 0))
    return out.select("_id", F.transform("_x", lambda v: F.floor(v) + shift).alias("_x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers as rows), by length of the vector, at most _BLOCK rows and 4 million entries at a time."""
    for batch in batches:
        lists = batch.column(1)
        lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            step = max(1, min(_BLOCK, 4_000_000 // int(dim)))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                yield batch.column(0).take(pa.array(some)), flat[starts[some][:, None] + np.arange(dim)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where they suffice, else in Python's whole numbers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its error (Knuth): both together are the exact sum."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_double(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (more, rest), all unevaluated sums of two doubles."""
    s, e = _two_sum(high, more)
    t, f = _two_sum(low, np.broadcast_to(rest, np.shape(low)))
    s, e = _two_sum(s, e + t)
    return _two_sum(s, e + f)


def outer_products(d: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices whose exact sum is the sum of the outer products of the rows of d, whole numbers.

    Error-free: rows are cut into signed slices of _BITS bits, and the product of two slices over a block is exact.
    """
    slices, half = [], 1 << (_BITS - 1)
    while not slices or (d != 0).any():
        low = ((d + half) & ((1 << _BITS) - 1)) - half
        slices.append(low.astype(np.float64))
        d = (d - low) >> _BITS
    for i, a in enumerate(slices):
        for j, b in enumerate(slices[: i + 1]):
            p = (a.T @ b) * 2.0 ** (_BITS * (i + j))
            yield p if i == j else p + p.T


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: count and exact sums by (length, dimension)."""
    found: dict[int, list] = {}
    for _, x in _blocks(batches):
        n, total = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
        own = x.sum(axis=0) if int(np.abs(x).max(initial=0)) < 2**50 else x.astype(object).sum(axis=0)
        found[x.shape[1]] = [n + len(x), [a + int(b) for a, b in zip(total, own)]]
    for dim, (n, total) in found.items():
        columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(str, total), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "n", "total"])


def _covariance(batches: Iterator[pa.RecordBatch], fits: dict[int, tuple[int, tuple[int, ...]]]) -> Iterator[pa.RecordBatch]:
    """Per task: the sum of the centred outer products by (length, row of the matrix), as high and low parts."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _, x in _blocks(batches):
        dim = x.shape[1]
        high, low = found.get(dim) or (np.zeros((dim, dim)), np.zeros((dim, dim)))
        for p in outer_products(centred(x, *fits[dim])):
            high, low = add_double(high, low, p)
        found[dim] = high, low
    yield from _matrices(found)


def _matrices(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for dim, (high, low) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(high)), pa.array(list(low))], ["dim", "i", "high", "low"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the tasks' parts as they come; what is kept is one row of the matrix for each key."""
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, i, high, low in zip(*(c.to_pylist() for c in batch.columns)):
            own = found.get((dim, i))
            found[dim, i] = add_double(*own, np.array(high), np.array(low)) if own else (np.array(high), np.array(low))
    if found:
        keys, parts = list(found), list(found.values())
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([list(p[0]) for p in parts], pa.list_(pa.float64())), pa.array([list(p[1]) for p in parts], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "high", "low"])


def solve(high: np.ndarray, low: np.ndarray, n: int, sums: tuple[int, ...], components: int = COMPONENTS) -> Fit:
    """Eigenvectors of (high + low) / n^3 by falling eigenvalue: reduction to a tridiagonal matrix, divide and conquer (LAPACK's dsyevd).

    high + low sums products of n * x - S, so that n^2 is in them and the divisor of the covariance is n^3.
    """
    trace = sum((Fraction(h) + Fraction(e) for h, e in zip(np.diag(high), np.diag(low))), Fraction(0))
    unit = 2.0 ** -int(np.frexp(np.abs(high).max(initial=0.0))[1])  # the solver sees entries up to 1
    a = (high + low) * unit
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    scale = Fraction(1) / Fraction(unit) / n**3
    return Fit(n, sums, np.array([float(Fraction(max(v, 0.0)) * scale) for v in values]), np.ascontiguousarray(vectors), float(trace / n**3))


def project(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Whitened coordinates (NaN on components without spread) and n * x - S."""
    d = centred(x, fit.n, fit.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (d.astype(np.float64) / fit.n) @ fit.vectors / np.sqrt(fit.values)
    out[:, ~fit.spread()] = np.nan
    return out, d


def _moments(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """Per task: sums of products of whitened coordinates; row k of the matrix of a length has the plain sums."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _, x in _blocks(batches):
        y, _ = project(x, fits[x.shape[1]])
        y = np.column_stack((np.nan_to_num(y), np.ones(len(y))))
        p = y.T @ y
        found[x.shape[1]] = add_double(*found[x.shape[1]], p) if x.shape[1] in found else (p, np.zeros_like(p))
    for dim, (high, low) in found.items():
        k = len(high)
        yield pa.RecordBatch.from_arrays([pa.array([dim] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(list(high)), pa.array(list(low))], ["dim", "i", "high", "low"])


def identity_error(high: np.ndarray, low: np.ndarray, fit: Fit) -> float:
    """The largest absolute entry of the whitened coordinates' covariance minus the identity, over components with spread."""
    m = (high + low) / fit.n
    cov, used = m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]), np.flatnonzero(fit.spread())
    return float(np.abs(cov - np.eye(len(cov)))[np.ix_(used, used)].max(initial=0.0))


def _rows(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit], errors: dict[int, float]) -> Iterator[pa.RecordBatch]:
    for ids, x in _blocks(batches):
        fit = fits[x.shape[1]]
        y, d = project(x, fit)
        most = int(np.abs(d).max(initial=0))
        exact = d if most * most * x.shape[1] < 2**63 else d.astype(object)
        square = (exact * exact).sum(axis=1)
        k, rows = y.shape[1], len(y)
        ratio = [float(v / fit.trace) if fit.trace > 0 else 0.0 for v in fit.values]
        columns = [
            ids.take(pa.array(np.repeat(np.arange(rows), k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * k, fit.n)),
            pa.array(np.repeat(np.array([str(int(s)) for s in square], object), k), pa.string()),
            pa.array(y.ravel(), from_pandas=True),
            pa.array(np.tile(ratio, rows)),
            pa.array(np.full(rows * k, errors[x.shape[1]])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


_PART = "dim int, i int, high array<double>, low array<double>"


def _gathered(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The matrix of each length: rows are merged where they are dealt, the driver sees length x length numbers."""
    out: dict[int, list] = {}
    for r in checkpointed(parts.repartition("dim", "i").mapInArrow(_merge, _PART)).orderBy("dim", "i").collect():
        out.setdefault(r.dim, []).append((r.high, r.low))
    return {dim: (np.array([h for h, _ in rows]), np.array([e for _, e in rows])) for dim, rows in out.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """-> (id_col, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double).

    Entries become whole numbers x = floor(scale * entry) + shift; the fit list is every row that takes part. Rows are
    centred as n * x - S, whole numbers, before anything is multiplied; their outer products are accumulated in
    double-double by error-free transformations in each task, and the tasks' high and low parts merged the same way.
    One row for each vector and component: its sum over dimensions of (n*x - S)^2, exact, and its whitened coordinate
    on the component. identity_error is measured on the whitened rows themselves.

    Rows whose vector is null or empty, or has an entry that is null, not finite or beyond 2^62 once scaled, take no
    part; rows without an id do. Vectors of different length are whitened apart, each length a fit list of its own.
    Repeated rows count each and are returned each. Ties between eigenvalues: any basis, the same for all rows. A component
    on which no row varies (one row only, equal rows, fewer rows than dimensions) has whitened null and is left out of
    identity_error (0 if none is left); explained is 0 where nothing varies. Vectors shorter than `components` have one
    component a dimension. Other columns are ignored. An empty table gives an empty result.

    Four passes over the vectors; shuffled are one matrix row per task and dimension. Driver and task closures hold
    length x length numbers, whatever the count of rows. Executors lost: parts are recomputed from the scan.
    """
    rows = whole(vectors, id_col, vec_col, scale, shift)
    sums = rows.mapInArrow(_sums, "dim int, i int, n long, total string").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    exact: dict[int, list] = {}
    for r in sums.orderBy("dim", "i").collect():
        exact.setdefault(r.dim, []).append((r.n, int(r.total)))
    lists = {dim: (own[0][0], tuple(s for _, s in own)) for dim, own in exact.items()}
    fits = {dim: solve(high, low, *lists[dim], components) for dim, (high, low) in _gathered(rows.mapInArrow(lambda it: _covariance(it, lists), _PART)).items()}
    errors = {dim: identity_error(high, low, fits[dim]) for dim, (high, low) in _gathered(rows.mapInArrow(lambda it: _moments(it, fits), _PART)).items()}
    out = rows.mapInArrow(lambda it: _rows(it, fits, errors), "_id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.select(F.col("_id").alias(id_col), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations beyond a long (some 10^8 rows of usual spread) are null here; the operator itself has them in full."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
