"""Numbered snapshots of a table; a reader sees whole snapshots only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    folder, files = _folder(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(m[1]) for m in (re.fullmatch(rf"{kind}-(\d+)", n) for n in names) if m)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the snapshots that are whole, rising."""
    return _numbers(spark, path, "done")


def save(df: DataFrame, path: str) -> int:
    """Write df as the next snapshot -> its number.

    A writer claims a number by creating a file that must not exist yet, writes the rows under it and marks them as done last.
    So writers at the same time take different numbers, and one that fails leaves a number that no reader ever takes.
    """
    spark = df.sparkSession
    _, files = _folder(spark, path)
    at = lambda kind, n: _folder(spark, f"{path}/{kind}-{n:06d}")[0]
    n = max(_numbers(spark, path, "claim"), default=-1) + 1
    while not files.createNewFile(at("claim", n)):
        n += 1
    df.write.mode("overwrite").parquet(f"{path}/rows-{n:06d}")
    files.createNewFile(at("done", n))
    return n


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The snapshot of that number, or the newest whole one; an error where there is none."""
    known = versions(spark, path)
    n = max(known, default=None) if version is None else version
    if n not in known:
        raise ValueError(f"{path} has no whole snapshot{'' if version is None else f' {version}'}")
    return spark.read.parquet(f"{path}/rows-{n:06d}")
