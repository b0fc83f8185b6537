"""Filter interaction audit: what five document filters remove in every order, alone and together."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed, table

#: Production parameters of op13: A words, B distinct words in a hundred, C capitals in a hundred code points, D signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"
#: Every set of filters as a number: filter k of FILTERS is bit k.
_SETS = range(1 << len(FILTERS))


def word_counts(rows: DataFrame, salts: int = 16) -> DataFrame:
    """rows(_id, _mark, _text) -> (_id, _mark, words long, distinct long): by (row, word) first, by row then.

    Texts are dealt by row once, so that neither aggregation shuffles words: they would be several times the texts. Rows that
    repeat an id and a text are dealt to `salts` places by the task that read them, so that no task gets all; in each place
    they meet in one group, a null word for each row counts them, and each has the group's words divided by that.
    """
    dealt = rows.select("_id", "_mark", "_text", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")).repartition("_id", "_mark", "_salt")
    split = F.concat(F.array(F.lit(None).cast("string")), F.split("_text", f"[{BLANKS}]+"))
    each = dealt.select("_id", "_mark", "_salt", F.explode(split).alias("_word")).filter("_word is null or _word <> ''")
    single = each.groupBy("_id", "_mark", "_salt", "_word").agg(F.count(F.lit(1)).alias("_n"))
    held = F.col("_word").isNotNull()
    total = single.groupBy("_id", "_mark", "_salt").agg(F.sum(F.when(held, F.col("_n"))).alias("_words"), F.count("_word").alias("_distinct"), F.sum(F.when(~held, F.col("_n"))).alias("_rows"))
    same = total.select("_id", "_mark", (F.coalesce("_words", F.lit(0)) / F.col("_rows")).cast("long").alias("_words"), "_distinct")
    return same.groupBy("_id", "_mark").agg(F.max("_words").alias("_words"), F.max("_distinct").alias("_distinct"))  # alike in all places


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """-> (_id, part, _set int): for each row the set of filters that it fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    base = base.withColumn("_mark", F.xxhash64("_text"))
    counts = word_counts(base)
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    own = base.select(
        "_id",
        "_mark",
        "part",
        (100 * capitals > MOST_CAPITALS * F.length("_text")).alias("_c"),
        F.col("_text").rlike(SIGNS).alias("_d"),
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
    )
    # Only texts that more than one id holds can make a copy; they are dealt anew for the join, so that large partitions can be split.
    first = own.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last").select("_digest", "_first")
    marked = own.join(checkpointed(first), "_digest", "left")
    joined = marked.join(counts.withColumnsRenamed({"_id": "_i", "_mark": "_m"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_mark") == F.col("_m")), "left")
    n, distinct = (F.coalesce(c, F.lit(0)) for c in ("_words", "_distinct"))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, F.col("_c"), F.col("_d"), F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))]
    return joined.select("_id", "part", sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int").alias("_set"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """-> (part, filter_order, step int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), the counts long.

    One row per value of part_col (null: empty string), order of the five filters and step. Null texts are empty: no words,
    so A fails, and B to D don't. A copy (E) has a text that also a smaller id has; rows that repeat an id are no copies of
    one another, and rows without an id neither are copies nor make any. Each row counts, repeated ones too. Labels meet
    rows by id; ids that repeat among the labels are good or toxic if any of their rows is; rows without a label are
    neither. Other columns are ignored. An empty table gives an empty result.

    Words are exploded and counted by (document, word), then by document. Documents then are counted by part in 32
    conditional counts, one for each set of filters that they fail, and as many for good and toxic ones: all orders follow
    from these, so that no order looks at a document again. Documents are told apart by id and, should ids repeat or lack,
    by a 64-bit hash of the text.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_label")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = flagged(docs, id_col, text_col, part_col).join(marks, F.col("_id") == F.col("_label"), "left")

    def counted(prefix: str, of: Column) -> list[Column]:
        return [F.count(F.when((F.col("_set") == s) & of, 1)).alias(f"{prefix}{s}") for s in _SETS]

    sets = rows.groupBy("part").agg(*counted("n", F.lit(True)), *counted("g", F.col("_good") == 1), *counted("t", F.col("_toxic") == 1))
    held = sets.select("part", *(F.array(*(f"{p}{s}" for s in _SETS)).alias(p) for p in "ngt"))
    orders = F.explode(F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " "))
    steps = held.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = [F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", k, 1)) - 1) for k in range(1, len(FILTERS) + 1)]
    before = sum((F.when(F.col("step") > k, bit).otherwise(0) for k, bit in enumerate(bits, 1)), F.lit(0))
    steps = steps.withColumn("own", F.get(F.array(*bits), F.col("step") - 1)).withColumn("before", before)
    sets_ = F.sequence(F.lit(0), F.lit(_SETS[-1]))

    def total(of: str, those: Callable[[Column], Column], times: Callable[[Column], Column] = lambda s: F.lit(1)) -> Column:
        return F.aggregate(F.filter(sets_, those), F.lit(0).cast("long"), lambda a, s: a + F.get(of, s) * times(s))

    def fails(s: Column) -> Column:
        return s.bitwiseAND(F.col("own")) != 0

    def alive(s: Column) -> Column:
        return s.bitwiseAND(F.col("before")) == 0

    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda s: alive(s) & ~fails(s)).alias("kept"),
        total("n", lambda s: alive(s) & fails(s)).alias("removed"),
        total("n", lambda s: ~alive(s) & fails(s)).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"),
        total("g", lambda s: alive(s) & fails(s)).alias("good_lost"),
        total("t", lambda s: alive(s) & fails(s)).alias("toxic_lost"),
        # a filter comes first among the k that a document fails in 120 / k of the orders
        total("n", fails, lambda s: (F.lit(120) / F.bit_count(s)).cast("long")).alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {
    "op13_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') AS ws
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word FROM d),
per AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY doc_id, word),
tot AS (SELECT doc_id, sum(n) AS words, count(*) AS distinct_words FROM per GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
         coalesce(tot.words, 0) < 200 AS a,
         100 * coalesce(tot.distinct_words, 0) < 50 * coalesce(tot.words, 0) AS b,
         100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t) AS c,
         regexp_matches(d.t, '[#$%&*|]') AS dd,
         d.doc_id > firsts.first_id AS e
  FROM d LEFT JOIN tot ON tot.doc_id = d.doc_id JOIN firsts ON firsts.t = d.t LEFT JOIN lab ON lab.doc_id = d.doc_id),
m AS (
  SELECT part, good, toxic, (CASE WHEN a THEN 1 ELSE 0 END) + (CASE WHEN b THEN 2 ELSE 0 END) + (CASE WHEN c THEN 4 ELSE 0 END)
         + (CASE WHEN dd THEN 8 ELSE 0 END) + (CASE WHEN e THEN 16 ELSE 0 END) AS mask
  FROM f),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
prefixes AS (
  SELECT letter AS filter_order, 1 AS step, bit, 0 AS before FROM letters
  UNION ALL
  SELECT p.filter_order || l.letter, p.step + 1, l.bit, p.before + p.bit
  FROM prefixes p JOIN letters l ON ((p.before + p.bit) & l.bit) = 0),
orders AS (
  SELECT full_.filter_order, p.step, p.bit, p.before
  FROM (SELECT filter_order FROM prefixes WHERE step = 5) full_ JOIN prefixes p ON starts_with(full_.filter_order, p.filter_order)),
parts AS (SELECT DISTINCT part FROM d),
cells AS (
  SELECT o.filter_order, o.step, o.bit, parts.part,
         coalesce(sum(g.n) FILTER (WHERE (g.mask & (o.before + o.bit)) = 0), 0) AS kept,
         coalesce(sum(g.n) FILTER (WHERE (g.mask & o.bit) <> 0 AND (g.mask & o.before) = 0), 0) AS removed,
         coalesce(sum(g.n) FILTER (WHERE (g.mask & o.bit) <> 0 AND (g.mask & o.before) <> 0), 0) AS redundant,
         coalesce(sum(g.n) FILTER (WHERE g.mask = o.bit), 0) AS unique_fails,
         coalesce(sum(g.good) FILTER (WHERE (g.mask & o.bit) <> 0 AND (g.mask & o.before) = 0), 0) AS good_lost,
         coalesce(sum(g.toxic) FILTER (WHERE (g.mask & o.bit) <> 0 AND (g.mask & o.before) = 0), 0) AS toxic_lost
  FROM orders o CROSS JOIN parts JOIN g ON g.part = parts.part GROUP BY o.filter_order, o.step, o.bit, parts.part),
shap AS (SELECT part, bit, sum(removed) AS shapley FROM cells GROUP BY part, bit)
SELECT c.part, c.filter_order, c.step::INTEGER AS step, c.kept::BIGINT AS kept, c.removed::BIGINT AS removed, c.redundant::BIGINT AS redundant,
       c.unique_fails::BIGINT AS unique_fails, c.good_lost::BIGINT AS good_lost, c.toxic_lost::BIGINT AS toxic_lost, s.shapley::BIGINT AS shapley
FROM cells c JOIN shap s ON s.part = c.part AND s.bit = c.bit
"""
}
