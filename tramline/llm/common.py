"""What several corpus operators share: tables, checkpoints, byte classes, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: ASCII letters for case folding that leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; a folder of our own only where none is configured and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/tramline-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def sliced(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about `most` bytes, so that a worker's copies of texts stay small whatever their length."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def numbered(df: DataFrame, key: str, bucket: Column, order: list[str], out: str, light: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key without gaps from 0, in two levels.

    Rows are dealt to (key, bucket); each pair is numbered by itself and starts where the counts of
    the key's earlier buckets end. No task sees all rows of a key, so a key may hold most rows.
    The running sums see one row per (key, bucket). light: the same rows by a cheaper plan, for counting.
    """
    df = df.withColumn("_bucket", bucket)
    light = df if light is None else light.withColumn("_bucket", bucket)
    counts = light.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(key, "_bucket").orderBy(*order)
    ranked = df.withColumn("_own", F.row_number().over(own))
    joined = ranked.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, (F.col("_start") + F.col("_own") - 1).cast("long")).drop("_own", "_k", "_b", "_start", "_bucket")


#: Edges whose components one task finds (a few MB); of more, rounds over all tasks do.
MOST_LOCAL = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            for x in (u, v):
                top.setdefault(x, x)
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, most_rounds: int = 60, most_local: int = MOST_LOCAL, written: bool = False) -> DataFrame:
    """edges(u long, v long) -> (node, component): component is the smallest node that can be reached.

    Up to most_local edges, counted first, go to one task. More alternate large-star and small-star steps until all is
    stars. Each step is a map-side combined minimum by node and an equi-join that sends every neighbour to it, so a hub's
    neighbours are never gathered in one place (the join's large partitions can be split). A checkpoint ends each round;
    the driver sees one row at most. Both ways give the same rows. written: the edges only read tables that are written
    out already, so that they are read twice rather than written again.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = now if written else checkpointed(now)
    if now.count() <= most_local:
        return checkpointed(now.coalesce(1).mapInArrow(_union_find, "node long, component long"))
    now = checkpointed(now.distinct())
    for _ in range(most_rounds):
        if not _unsettled(now).head(1):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written out, so that both sides of the join are dealt for it and a hub's partition can be split
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(floor.select("u", F.col("m").alias("v")).union(moved).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that keep edges (u > v) from being stars around the smaller end: with two smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("_top")).union(edges.select(F.col("v").alias("node"), F.lit(None).cast("long"), F.lit(True)))
    found = ends.groupBy("node").agg(F.min("v").alias("_a"), F.max("v").alias("_b"), F.max("_top").alias("_top"))
    return found.filter("_a <> _b or (_top and _a is not null)").select("node")
