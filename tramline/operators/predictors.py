"""Predictors of missing elements: window statistics of the similarity matrix around each assignment."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DUMMY_SENTENCE
from ..functions.text import harmonic_mean, ratio

_c = F.col


def trivial_alignment(sims: DataFrame, case: list[str], sent: str = "sent_id", elem: str = "elem_id", digits: int | None = None, few: bool = False) -> DataFrame:
    """Each element's most similar sentence, ties to the smallest id: one combined aggregation, no window.

    digits, if given: similarities that agree when rounded to so many digits are ties; the one returned is not rounded.
    few: there are few rows, as of similarity.local_statistics; the greatest of each element is found first and broadcast, and rows
    are read twice, but never sorted, as they are to combine structs.
    """
    rank = _c("sim") if digits is None else F.round("sim", digits)
    if few:
        top = sims.groupBy(*case, elem).agg(F.max("sim").alias("_top"))
        slack, top_rank = (0.0, _c("_top")) if digits is None else (2 * 10.0**-digits, F.round("_top", digits))
        near = sims.join(F.broadcast(top), [*case, elem])
        ties = near.filter((_c("sim") >= _c("_top") - slack) & (rank >= top_rank))  # few rows are rounded, which an equality, as a key of the join, would do to all
        return ties.groupBy(*case, elem).agg(F.min(sent).alias("_s"), F.min_by("sim", sent).alias("sim")).select(*case, elem, _c("_s").alias(sent), "sim")
    best = F.max_by(F.struct(_c(sent), _c("sim")), F.struct(rank, -_c(sent)))
    return sims.groupBy(*case, elem).agg(best.alias("_b")).select(*case, elem, _c(f"_b.{sent}").alias(sent), _c("_b.sim").alias("sim"))


def statistics(sims: DataFrame, alignment: DataFrame, case: list[str], sizes: DataFrame, sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """alignment with the maxima, sums and sizes of its element's, its sentence's and its case's similarities.

    sims may be sparse (absent pairs are 0): means divide by the sizes (n_sents, n_elems) per case. Each statistic is an
    aggregation by its own key that joins the alignment, which has one row per element.
    """
    p = F.col("sim")
    by_elem = sims.groupBy(*case, elem).agg(
        F.max("sim").alias("t_max"), F.sum("sim").alias("t_sum"), F.sqrt(F.sum(p * p)).alias("t_l2"), F.sum(F.when(p > 0, p * F.log(p))).alias("t_plogp"), F.sum(F.when(p > 0, p)).alias("t_pos"),
        F.coalesce(F.sum(F.when(_c(sent) != DUMMY_SENTENCE, p)), F.lit(0.0)).alias("t_real"), F.count_if(_c(sent) == DUMMY_SENTENCE).alias("t_dummies"),
    )
    by_sent = sims.groupBy(*case, sent).agg(F.max("sim").alias("s_max"), F.sum("sim").alias("s_sum"))
    return _joined(alignment, by_elem, by_sent, sims.groupBy(*case).agg(F.max("sim").alias("c_max")), case, sizes, sent, elem)


def folded(parts: DataFrame, by_sent: DataFrame, alignment: DataFrame, sizes: DataFrame, sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """statistics of one case from the rows of similarity.local_statistics and, for the aligned sentences at least, local_sentence_statistics."""
    sums = [F.sum(c).alias(c) for c in ("t_sum", "t_plogp", "t_pos", "t_real", "t_dummies")]
    by_elem = parts.filter("t_max is not null").groupBy(elem).agg(F.max("t_max").alias("t_max"), F.sqrt(F.sum("t_sq")).alias("t_l2"), *sums)
    return _joined(alignment, by_elem, by_sent, parts.agg(F.max("t_max").alias("c_max")), [], sizes, sent, elem)


def _joined(alignment: DataFrame, by_elem: DataFrame, by_sent: DataFrame, whole: DataFrame, case: list[str], sizes: DataFrame, sent: str, elem: str) -> DataFrame:
    aligned = alignment.groupBy(*case).agg(F.avg("sim").alias("a_avg"))
    out = alignment.join(by_elem, [*case, elem]).join(by_sent, [*case, sent])
    for df in (whole, aligned, sizes):
        out = out.join(df, case) if case else out.crossJoin(F.broadcast(df))  # one row
    return out


def predictor(name: str) -> Column:
    m = _c("sim")
    if name == "p-sim":
        return m
    if name == "p-rel":
        return ratio(m, _c("c_max"))
    if name == "p-rel-T":
        return ratio(m, _c("t_max"))
    if name == "p-avg-T":
        return ratio(m, _c("t_sum") / _c("n_sents"))
    if name == "p-avgN-T":
        return ratio(m, _c("t_sum"))
    if name == "p-rel-S":
        return ratio(m, _c("s_max"))
    if name == "p-avgN-S":
        return ratio(m, _c("s_sum"))
    if name == "p-avg-S":
        return ratio(m, _c("s_sum") / _c("n_elems"))
    if name == "S-diff":
        return m - ratio(_c("t_real"), _c("n_sents") - _c("t_dummies"))  # the average over real sentences
    if name == "A-diff":
        return m - _c("a_avg")
    if name == "entropy-S":  # of the non-zero similarities, scaled to length 1 (not to sum 1)
        return -(_c("t_plogp") - _c("t_pos") * F.log(_c("t_l2"))) / _c("t_l2")
    if name == "entropy-ensemble":
        return harmonic_mean(predictor("entropy-S"), predictor("p-rel-S"))
    if name == "students-missing":
        return harmonic_mean(predictor("p-rel-S"), predictor("p-sim"))
    parts = name.split("+")
    if len(parts) == 3:
        return sum(map(predictor, parts[1:]), predictor(parts[0])) / 3
    raise ValueError(f"no such predictor: {name}")


BASIC = ["p-sim", "p-rel", "p-rel-T", "p-avg-T", "p-avgN-T", "p-rel-S", "p-avgN-S", "p-avg-S", "S-diff", "A-diff", "entropy-S", "entropy-ensemble", "students-missing"]
ENSEMBLES = ["+".join(c) for c in combinations(["p-sim", "p-rel", "p-rel-S", "p-rel-T", "p-avg-S", "p-avg-T"], 3)]


def cutoff(stats: DataFrame, name: str, threshold: float, sent: str = "sent_id") -> DataFrame:
    """Elements whose predictor is below the threshold lose their sentence (missing)."""
    value = predictor(name)
    return stats.withColumn("value", value).withColumn("missing", F.coalesce(value < threshold, F.lit(False))).withColumn(sent, F.when(~_c("missing"), _c(sent)))


def sweep(stats: DataFrame, names: list[str], thresholds: list[float], keep: list[str]) -> DataFrame:
    """-> (keep, predictor, threshold, missing) for every predictor and threshold, in one pass over the statistics."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), predictor(n).cast("double").alias("value")) for n in names])).alias("_v")
    out = stats.select(*keep, values).select(*keep, "_v.*").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return out.select(*keep, "predictor", "threshold", F.coalesce(_c("value") < _c("threshold"), F.lit(False)).alias("missing"))
