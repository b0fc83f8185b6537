"""Comparison of alignments with ground truths, and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees


def answer(sent: Column, err: Column) -> Column:
    """What is compared: the sentence, or the error code where there is none (only "m" is known)."""
    return F.coalesce(sent.cast("string"), F.when(err == "m", err), F.lit("no-match"))


def gt_structure(alignment: DataFrame, case: str = "case_id") -> DataFrame:
    """alignment(case, elem_id, sent_id from 1, null: missing) -> (case, elem_id, sent_id from 0, err)."""
    return alignment.select(case, "elem_id", (F.col("sent_id") - 1).alias("sent_id"), F.when(F.col("sent_id").isNull(), "m").alias("err"))


def scored_elements(elements: DataFrame, edges: DataFrame, case: str = "case_id") -> DataFrame:
    """The elements that an extended ground truth speaks of: tasks, gateways with one way in and some out, events with a name."""
    ways = degrees(edges, [case]).withColumnRenamed("node", "elem_id")
    wanted = (F.col("elem_type") == "Task") | ((F.col("elem_type") == "Event") & F.col("name").isNotNull())
    split = (F.col("elem_type") == "Gateway") & (F.col("n_in") == 1) & (F.col("n_out") >= 1)
    return elements.join(ways, [case, "elem_id"], "left").filter(F.coalesce(wanted | split, F.lit(False))).select(*elements.columns)


def extended_structure(alignment: DataFrame, elements: DataFrame, edges: DataFrame, sentences: DataFrame, case: str = "case_id") -> DataFrame:
    """-> (case, elem_id, class, sent_id from 0, err, n_sents): gt_structure of the scored elements.

    Elements that the alignment leaves out are rows without sentence and error. n_sents is 0 in a case without sentences.
    """
    own = scored_elements(elements, edges, case).select(case, "elem_id", F.lower("elem_type").alias("class"))
    sizes = sentences.groupBy(case).agg(F.count(F.lit(1)).alias("_n"))
    known = own.join(gt_structure(alignment, case), [case, "elem_id"], "left").join(sizes, case, "left")
    return known.select(case, "elem_id", "class", "sent_id", "err", F.coalesce("_n", F.lit(0)).alias("n_sents"))


def compare(predicted: DataFrame, truth: DataFrame, case: str = "case_id") -> DataFrame:
    """-> (case, elem_id, correct boolean, one_sided boolean) by a full join on the element."""
    p = predicted.select(case, "elem_id", answer(F.col("sent_id"), F.col("err")).alias("_p"))
    t = truth.select(case, "elem_id", answer(F.col("sent_id"), F.col("err")).alias("_t"))
    return p.join(t, [case, "elem_id"], "full").select(case, "elem_id", F.coalesce(F.col("_p") == F.col("_t"), F.lit(False)).alias("correct"), (F.col("_p").isNull() | F.col("_t").isNull()).alias("one_sided"))


def accuracy_by_class(compared: DataFrame, classes: DataFrame, case: str = "case_id") -> DataFrame:
    """-> (case, class, n_correct, n_total, accuracy): per class and "all", in one pass with grouping sets."""
    joined = compared.join(classes.select(case, "elem_id", "class"), [case, "elem_id"])
    sets = joined.groupingSets([[F.col(case)], [F.col(case), F.col("class")]], F.col(case), F.col("class"))
    out = sets.agg(F.grouping_id().alias("_g"), F.count_if("correct").alias("n_correct"), F.count(F.lit(1)).alias("n_total"))
    return out.select(case, F.when(F.col("_g") == 1, "all").otherwise(F.col("class")).alias("class"), "n_correct", "n_total", (F.col("n_correct") / F.col("n_total")).alias("accuracy"))


def accuracy_summary(per_case: DataFrame, by: list[str]) -> DataFrame:
    """-> (by, mean_case_accuracy, pooled_accuracy, median_accuracy); cases without elements (null) are skipped."""
    return per_case.groupBy(*by).agg(
        F.avg("accuracy").alias("mean_case_accuracy"), (F.sum("n_correct") / F.nullif(F.sum("n_total"), F.lit(0))).alias("pooled_accuracy"), F.median("accuracy").alias("median_accuracy")
    )


def compare_many(answers: dict[str, DataFrame], case: str = "case_id") -> DataFrame:
    """-> (case, elem_id, held long, agree long, answer string, one_sided boolean) for any number of annotators.

    One tagged union and one aggregation by element. Bit k of held: annotator k (in the order of answers) has the element;
    bit k of agree: its answer is the one that most annotators give (ties: the smaller text). one_sided: not all have it.
    An annotator that answers twice for an element counts with its smaller answer.
    """
    tagged = None
    for k, df in enumerate(answers.values()):
        own = df.select(case, "elem_id", F.lit(1 << k).cast("long").alias("_bit"), answer(F.col("sent_id"), F.col("err")).alias("_a"))
        tagged = own if tagged is None else tagged.unionByName(own)
    once = tagged.groupBy(case, "elem_id", "_bit").agg(F.min("_a").alias("_a"))
    same = once.groupBy(case, "elem_id", "_a").agg(F.sum("_bit").alias("_bits"))
    best = F.struct((-F.bit_count("_bits")).alias("n"), F.col("_a").alias("a"), F.col("_bits").alias("bits"))
    out = same.groupBy(case, "elem_id").agg(F.sum("_bits").alias("held"), F.min(best).alias("_best"))
    return out.select(case, "elem_id", "held", F.col("_best.bits").alias("agree"), F.col("_best.a").alias("answer"), (F.col("held") != (1 << len(answers)) - 1).alias("one_sided"))
