"""Line dedup: lines that many documents share survive in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed, fold_ascii, table

#: Production parameters of op2.
LEAST_CHARS, LEAST_DOCS = 40, 5


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """-> (id_col, n_lines long, n_dropped long, text string), one row per input row.

    Lines are split at \\n; a line's key is the line stripped of ASCII white space with A-Z lower-cased.
    A key of at least least_chars code points that at least least_docs distinct ids hold loses its lines
    everywhere but in its largest id. Other lines keep their order.
    Null and empty texts are one empty line. Ties: lines that repeat in the keeping document all stay there.
    Rows that repeat an id count as one holder and are treated alike. Rows without an id are no holders and
    lose no lines. Other columns are ignored. An empty table gives an empty result.

    Plan: each text is split where it lies and only 16-byte digests of its distinct long keys are shuffled;
    documents per digest are counted by (digest, id) and then by digest, both combined before the shuffle, so
    a line that all documents share is spread over all tasks. Texts move once, by id, to meet their drop list.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = base.filter(F.col("_id").isNotNull()).select("_id", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = lines.filter(F.length("_line") >= least_chars).select("_id", "_pos", F.btrim("_line", F.lit(BLANKS)).alias("_key"))
    keyed = keyed.filter(F.length("_key") >= least_chars).select("_id", "_pos", F.unhex(F.substring(F.sha2(fold_ascii(F.col("_key")), 256), 1, 32)).alias("_digest"))
    frequent = keyed.groupBy("_digest").agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_keeper")).filter(F.col("_docs") >= least_docs)
    frequent = checkpointed(frequent.select("_digest", "_keeper"))  # dealt anew for the join, so that its large partitions can be split
    drops = keyed.join(frequent, "_digest").filter("_id <> _keeper").groupBy("_id").agg(F.collect_set("_pos").alias("_drop"))
    met = base.join(drops, "_id", "left").select("_id", F.split("_text", "\n", -1).alias("_lines"), F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    return met.select(
        F.col("_id").alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_drop").cast("long").alias("n_dropped"),
        F.concat_ws("\n", F.transform(keep, lambda i: F.get("_lines", i))).alias(text_col),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT a.doc_id, a.pos, a.line, b.k IS NOT NULL AND a.doc_id <> b.keeper AS dropped
  FROM keyed a LEFT JOIN frequent b ON a.k = b.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
