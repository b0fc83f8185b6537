"""A cache of analyses: a table addressed by content, to which only what is new is added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

#: Hexadecimal digits of a key that name its folder: 256 folders, so that a look-up by key reads few files.
PREFIX = 2


def keyed(texts: DataFrame, *parts: str) -> DataFrame:
    """texts with `key`: sha-256 over the lengths and contents of parts (null is told from empty), and its prefix."""
    pieces = [F.coalesce(F.concat(F.octet_length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("-")) for p in parts]
    return texts.withColumn("key", F.sha2(F.concat_ws("|", *pieces), 256)).withColumn("prefix", F.substring("key", 1, PREFIX))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache's rows, the newest of each key (by stamp) only; an empty table where there is none yet."""
    own = f"key string, stamp long, {schema}, prefix string"
    kept = spark.createDataFrame([], own)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        kept = spark.read.schema(own).parquet(path)
    newest = Window.partitionBy("key").orderBy(F.desc("stamp"))
    return kept.withColumn("_r", F.rank().over(newest)).filter("_r = 1").drop("_r")


def add(spark: SparkSession, path: str, rows: DataFrame, stamp: int, schema: str) -> int:
    """Add rows(key, prefix, columns of schema) under stamp; -> how many keys were new or newer.

    Rows of a key that the cache has under this stamp or a later one are left out, so that a batch that is added again, or
    is half written and run again, adds nothing twice. A later stamp replaces a key's rows.
    """
    held = stored(spark, path, schema).filter(F.col("stamp") >= stamp).select("prefix", "key").distinct()
    fresh = checkpointed(rows.join(held, ["prefix", "key"], "left_anti"))  # analysed once, though counted and written
    columns = [c.split()[0] for c in schema.split(", ")]
    out = fresh.select("key", F.lit(stamp).cast("long").alias("stamp"), *columns, "prefix").repartition("prefix")
    n = fresh.select("key").distinct().count()
    if n:
        out.write.mode("append").partitionBy("prefix").parquet(path)
    return n


def cached(spark: SparkSession, path: str, texts: DataFrame, parts: list[str], analyse: Callable[[DataFrame], DataFrame], schema: str, stamp: int = 0) -> tuple[DataFrame, int]:
    """-> (rows of texts with what analyse says of each, how many distinct texts were analysed now).

    analyse takes distinct (key, prefix, parts) and gives (key, prefix, columns of schema), any number of rows a key. Only
    keys that the cache lacks reach it: they are found by an anti-join on (prefix, key). A second run analyses nothing.
    """
    asked = keyed(texts, *parts)
    known = stored(spark, path, schema).select("prefix", "key").distinct()
    missing = asked.select("key", "prefix", *parts).dropDuplicates(["key"]).join(known, ["prefix", "key"], "left_anti")
    n = add(spark, path, analyse(missing), stamp, schema)
    found = stored(spark, path, schema).drop("stamp")
    return asked.join(found, ["prefix", "key"]).drop("prefix"), n
