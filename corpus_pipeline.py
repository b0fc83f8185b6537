"""A training-data pipeline over `documents`: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, and its decisions take effect.
All but the last return the columns of documents, whatever further ones there are. In every stage null texts count as
empty; empty and very long texts are rows like any other; an empty table gives an empty result. Which row of a group of
copies stays does not depend on the order of rows, and rows are told apart by id and text, so that a unique text stays
whatever other row has its id, and of rows without an id as many go as of rows with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import BLANKS, checkpointed, table
from tramline.llm.exact_dedup import exact_dedup
from tramline.llm.packing import pack
from tramline.llm.quality import fit, keep_good
from tramline.llm.simhash import similar_dedup
from tramline.llm.surrogates import KEY, pseudonymise


def _digest(text: Column) -> Column:
    """What exact_dedup gives as text_sha256, by built-in functions."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", ""), 256)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted rules reject go; empty texts are scored like others."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest as written, then the smallest id.

    Rows that repeat an id and a text (or have no id) come out of exact_dedup alike; of those, few in number, the longest
    one stays. They alone are dealt by text.
    """
    found = checkpointed(exact_dedup(docs).filter("group_size > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
    alike = found.filter("kept").groupBy("__id", "__sha").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__id", "__sha")
    keyed = docs.withColumn("__digest", _digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha"))
    left = keyed.join(found.filter("not kept").select("__id", "__sha").distinct(), same, "left_anti")
    if alike.head(1):
        longest = Window.partitionBy("doc_id", "__digest").orderBy(F.desc(F.length("text")), "text")
        one = left.join(alike, same, "left_semi").withColumn("__r", F.row_number().over(longest)).filter("__r = 1").drop("__r")
        left = left.join(alike, same, "left_anti").unionByName(one)
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8) stays, that with the smallest id.

    Where ids repeat or lack, rows are told apart by a hash of id and text instead, below all ids; such a row stays before others.
    """
    repeated = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 or __id is null").select("__id")
    own = F.col("doc_id").cast("long")
    keyed = docs
    if repeated.head(1):
        keyed = keyed.join(checkpointed(repeated).withColumn("__again", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        hashed = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(2**63)))
        own = F.when(F.col("__again"), hashed).otherwise(own)
    keyed = keyed.withColumn("__row", own)
    copies = similar_dedup(keyed.select(F.col("__row").alias("doc_id"), "text")).filter("component_id <> doc_id").select(F.col("doc_id").alias("__row"))
    return keyed.join(copies, "__row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the text. Null and empty texts stay as they are."""
    out = pseudonymise(docs, KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, in sequences; an empty text is a piece of one id."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("PII", personal_data),
    ("packing", packing),
]

#: Fitted rules, fingerprints and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
