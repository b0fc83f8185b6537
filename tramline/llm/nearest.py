"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Production parameters of op9; see the README for the recall they reach.
NEIGHBOURS, TABLES, PROBES, QUERY_STEP = 20, 10, 10, 20
#: Rows of a bucket and queries to it that meet in one task.
_BLOCK_ROWS, _BLOCK_QUERIES = 4096, 1024
#: Classes of length for each doubling; lengths of 0.84 to 1.19 are one class.
_LEVELS = 2


def _width(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def rotate(x: np.ndarray, number: int, seed: int = 7) -> np.ndarray:
    """A fast pseudo-random rotation: three rounds of random signs and a Hadamard transform, padded to a power of two."""
    width = _width(x.shape[1])
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, number, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y *= s
        h = 1
        while h < width:
            z = y.reshape(len(y), -1, 2, h)
            y = np.concatenate((z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]), axis=2).reshape(len(y), width)
            h *= 2
        y /= np.sqrt(width)
    return y


def _axes(x: np.ndarray, number: int, most: int) -> np.ndarray:
    """The signed axes nearest to each unit vector, nearest first; axis i is bucket 2i, its opposite 2i + 1."""
    y = rotate(x, number)
    both = np.stack((y, -y), axis=2).reshape(len(y), -1)
    if most == 1:
        return both.argmax(axis=1)[:, None]
    top = np.argpartition(-both, most - 1, axis=1)[:, :most] if most < both.shape[1] else np.tile(np.arange(both.shape[1]), (len(both), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors' originals as float64) by dimension."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        yield ids[own], flat[starts[own][:, None] + np.arange(dim)]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and classes of length; scaled first, so that no square overflows or vanishes."""
    most = np.abs(x).max(axis=1, keepdims=True)
    length = np.linalg.norm(x / most, axis=1, keepdims=True)
    return x / most / length, np.floor((np.log2(most) + np.log2(length))[:, 0] * _LEVELS + 0.5).astype(int)


def _cells(batches: Iterator[pa.RecordBatch], tables: int, probes: int, rows: dict[tuple[int, int, int, int], int], asks: dict | None, least: int, query: bool) -> Iterator[pa.RecordBatch]:
    """Deal vectors to cells (dim, class of length, table, bucket, row block, query block).

    A row lies in one block of its bucket in each table and meets every query block there; a query goes to one
    query block of its buckets in every class and meets every row block. asks None: only the buckets, for counting;
    a query's are those with rows.
    """
    levels: dict[int, set[int]] = {}
    for cell in rows:
        levels.setdefault(cell[0], set()).add(cell[1])

    def counts(of: dict, dim: int, level: int, t: int) -> np.ndarray:
        return np.array([of.get((dim, level, t, b), 0) for b in range(2 * _width(dim))], np.int64)

    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
        packed: list[bytes] = []
        taken: list[np.ndarray] = []
        for ids, x in _vectors(batch):
            dim, (unit, own), first = x.shape[1], _unit(x), len(packed)
            if asks is not None:
                packed += [_pack(v) for v in x]
            for t in range(tables):
                axes = _axes(unit, t, 2 * _width(dim) if query and t == 0 else min(probes, 2 * _width(dim)) if query else 1)
                for level in levels.get(dim, ()) if query else np.unique(own).tolist():
                    who = np.arange(len(ids)) if query else np.flatnonzero(own == level)
                    held = counts(rows, dim, level, t)
                    if query:
                        there = held[axes]
                        seen = np.cumsum(there, axis=1) - there
                        n, p = np.nonzero((there > 0) & ((np.arange(axes.shape[1]) < probes) | (t == 0) & (seen < least)))
                        bucket = axes[n, p]
                    else:
                        n, bucket = who, axes[who, 0]
                    across = down = np.zeros(len(n), np.int64)
                    if asks is not None:
                        wide, high = -(-held // _BLOCK_ROWS), -(-counts(asks, dim, level, t) // _BLOCK_QUERIES)
                        mix = (ids[n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(13) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                        times = (wide if query else high)[bucket]  # blocks of the other side
                        at = np.repeat(np.arange(len(n)), times)
                        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                        fixed = (mix % np.maximum(1, (high if query else wide)[bucket]))[at]
                        n, bucket, across, down = n[at], bucket[at], *((nth, fixed) if query else (fixed, nth))
                    for column, value in zip(out, (np.full(len(n), dim), np.full(len(n), level), np.full(len(n), t), bucket, across, down, ids[n])):
                        column.append(value)
                    taken.append(first + n)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        vectors = pa.array(packed, pa.binary()).take(pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64))) if asks is not None else pa.array([b""] * len(flat[0]), pa.binary())
        kinds = [pa.int32()] * 6 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(flat, kinds)), vectors], ["dim", "level", "tab", "bucket", "across", "down", "key", "vector"])


def _pack(v: np.ndarray) -> bytes:
    """In single precision where that loses nothing."""
    short = v.astype("<f4")
    return (short if (short == v).all() else v).tobytes()


def _unpack(packed: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(p, "<f4" if len(p) == 4 * dim else "<f8").astype(np.float64) for p in packed])


_CELL = "dim int, level int, tab int, bucket int, across int, down int, key long, vector binary"
_KEYS = ["dim", "level", "tab", "bucket", "across", "down"]


def _nearest(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Each query's k best rows of one cell, by the inner product of the original vectors."""
        found: list[tuple[np.ndarray, ...]] = []
        if len(rows) and len(queries):
            ids, asked = rows.key.to_numpy(), queries.key.to_numpy()
            x, q = (_unpack(d.vector, int(d.dim.iloc[0])) for d in (rows, queries))
            for at in range(0, len(q), 256):
                block, own = q[at : at + 256], asked[at : at + 256]
                scores = block @ x.T
                scores[own[:, None] == ids[None, :]] = -np.inf
                edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(block), -np.inf)
                # sums of products round by so much at most, whatever the order they are added in
                with np.errstate(over="ignore"):
                    slack = 4 * x.shape[1] ** 2 * np.finfo(float).eps * np.abs(block).max(axis=1) * np.abs(x).max()
                slack = np.where(np.isfinite(slack), slack, 0.0)
                i, j = np.nonzero((scores >= (edge - slack)[:, None]) & (scores > -np.inf))
                exact = np.einsum("ij,ij->i", block[i], x[j])  # the same sum whatever the cell
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                best = nth < k
                found.append((own[i[best]], ids[j[best]], exact[best]))
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """-> (query_id, rank int from 1, vec_id, score double): each query's k nearest rows found, but itself.

    Every table assigns every unit vector to the nearest signed axis of its own pseudo-random rotation. A query probes
    the axes nearest to it in each table, in the first as many as it takes to meet k + 1 rows (so fewer than k + 1
    vectors are all found), and does so in each class of rows of like length (half a doubling), for within a class the
    nearest by angle are nearly those of the largest inner product, and short rows can't crowd out long ones. All rows of the probed buckets are reranked by the exact inner product of the original
    vectors in double precision; ties go to the smaller id. No bucket, candidate or partner is capped: crowded
    buckets are split into blocks of rows and of queries, and every block of rows meets every block of queries.
    Vectors null, zero or with null or non-finite components take no part, nor do rows without an id; vectors of
    different dimension never meet. Repeated ids with the same vector count once per query. An empty table gives an
    empty result; other columns are ignored.

    Only counts of buckets (2 x dim x tables for each class of length) reach the driver.
    """
    rows, asks = (_valid(df, id_col, vec_col) for df in (vectors, queries))

    def counted(df: DataFrame, rows: dict, query: bool) -> dict[tuple[int, int, int, int], int]:
        cells = df.mapInArrow(lambda it: _cells(it, tables, probes, rows, None, k + 1, query), _CELL)
        return {tuple(r[:4]): r[4] for r in cells.groupBy("dim", "level", "tab", "bucket").count().collect()}

    held = counted(rows, {}, False)
    asked = counted(asks, held, True)  # with the further buckets that a query goes on to
    dealt = [df.mapInArrow(lambda it, q=q: _cells(it, tables, probes, held, asked, k + 1, q), _CELL) for df, q in ((rows, False), (asks, True))]
    met = dealt[0].groupBy(*_KEYS).cogroup(dealt[1].groupBy(*_KEYS)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vector = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall("_vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("_id"), vector.alias("_vector"))
    return out.filter(F.col("_id").isNotNull() & F.col("_vector").isNotNull() & fine & F.exists("_vector", lambda v: v != 0))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))
