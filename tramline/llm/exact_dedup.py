"""Exact dedup by skew-safe combining, with the full content compared at every stage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed, sliced, table

_BLANK_BYTES = BLANKS.encode()


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _normal(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes], content: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, digest, sha, chars[, content]); content is the normalised text, packed without loss."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        plain = [t.encode().translate(None, _BLANK_BYTES) for t in texts]
        shas = [sha256(p) for p in plain]
        columns = [batch.column(0), pa.array(shas if digest is sha256 else [digest(p) for p in plain], pa.binary()), pa.array(shas, pa.binary()), pa.array(map(len, texts), pa.int64())]
        if content:
            columns.append(pa.array(map(packer.compress, plain), pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["_id", "_digest", "_sha", "_chars", "_content"][: len(columns)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """-> (id_col, keep_id, group_size long, kept boolean, text_sha256 string), one row per input row.

    Texts are equal if they are after deleting ASCII white space; null counts as empty. The row with the most
    code points in the original text stays, ties go to the smallest id. Rows that repeat an id and a text count
    each in group_size and stand or fall together; a row without an id stays only if its group has no ids.
    ids are whole numbers. Other columns are ignored. An empty table gives an empty result.

    1. Each task combines its own rows by (digest, content).
    2. What is left is dealt by (digest, salt, content) and combined again: a text that a third of all rows
       hold is split over `salts` groups, of one row a task each.
    3. The salts' winners, `salts` rows a text at most, are dealt by digest and combined by (digest, content).
    Grouping keys hold the packed text itself (the same text packs to the same bytes), so equal digests alone
    never merge two texts. Winners carry a count of texts per digest; rows whose digest has several texts
    (a collision) find their winner by content, all others by digest.
    digest: for tests, a weaker one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    kinds = "_id long, _digest binary, _sha binary, _chars long"
    whole = base.mapInArrow(lambda it: _normal(it, digest, True), f"{kinds}, _content binary")
    # One whole number orders by length and then by id, so that the maximum stays in fixed-width hash aggregation.
    # An id's part runs from 1 (the largest) to 2^64 (the smallest) and is 0 without an id.
    step, top = (F.lit(x).cast("decimal(20,0)") for x in ("20000000000000000000", "9223372036854775808"))
    order = F.col("_chars").cast("decimal(11,0)") * step + F.coalesce(top - F.col("_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))  # follows the task: its combined rows then stay together
    rows = whole.select("_digest", "_content", salt.alias("_salt"), order.cast("decimal(36,0)").alias("_order"), F.lit(1).cast("long").alias("_n"))
    best = [F.max("_order").alias("_order"), F.sum("_n").alias("_n")]
    salted = rows.groupBy("_digest", "_salt", "_content").agg(*best)
    classes = salted.repartition("_digest").groupBy("_digest", "_content").agg(*best)
    part = (F.col("_order") % step).cast("decimal(20,0)")
    keep = F.when(part > 0, (top - part).cast("long"))
    many = F.count(F.lit(1)).over(Window.partitionBy("_digest"))
    winners = classes.withColumn("_texts", many).filter("_n > 1 or _texts > 1")
    winners = checkpointed(winners.select("_digest", F.when(F.col("_texts") > 1, F.col("_content")).alias("_content"), keep.alias("_keep"), "_n"))
    plain = winners.filter("_content is null")
    light = base.mapInArrow(lambda it: _normal(it, digest, False), kinds)
    clash = winners.filter("_content is not null")
    if clash.head(1):  # only if two texts share a digest
        crowded = clash.select("_digest").distinct()
        light = light.join(crowded, "_digest", "left_anti")
        split = whole.join(crowded, "_digest", "left_semi").join(clash, ["_digest", "_content"]).select("_digest", "_id", "_sha", "_keep", "_n")
    joined = light.join(plain.select("_digest", "_keep", "_n"), "_digest", "left").select("_digest", "_id", "_sha", "_keep", "_n")
    if clash.head(1):
        joined = joined.unionByName(split)
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents),
g AS (SELECT norm, count(*)::BIGINT AS group_size FROM t GROUP BY norm),
w AS (SELECT norm, doc_id AS keep_id FROM
      (SELECT norm, doc_id, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS r FROM t) WHERE r = 1)
SELECT t.doc_id, w.keep_id, g.group_size, t.doc_id = w.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm JOIN w ON t.norm = w.norm
"""
}
