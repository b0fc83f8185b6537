"""Many settings over many cases: accuracies by case, class and setting, and their summary."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import evaluate, graph
from .align import align, align_population, evaluate_population, evaluate_run


def run_benchmark(models: DataFrame, texts: DataFrame, truth: DataFrame, settings: dict[str, Config]) -> tuple[DataFrame, dict[str, float]]:
    """-> ((setting, case_id, class, n_correct, n_total, accuracy), seconds by setting).

    Only cases with model, text and truth take part. Settings that differ in the weights of features only are one population:
    their cases are analysed once and aligned in one job, and each is given an equal share of its seconds.
    """
    cases = graph.checkpointed(models.select("case_id").intersect(texts.select("case_id")).intersect(truth.select("case_id")))
    m, t, g = (df.join(cases, "case_id", "left_semi") for df in (models, texts, truth))
    out, seconds = [], {}
    for config, weights in populations(settings):
        began = time.time()
        if len(weights) == 1:
            (name,) = weights
            found = evaluate_run(align(m, t, settings[name]), g).withColumn("setting", F.lit(name))
        else:
            found = evaluate_population(align_population(m, t, weights, config), g)
        out.append(graph.checkpointed(found))
        seconds |= dict.fromkeys(weights, (time.time() - began) / len(weights))
    return reduce(DataFrame.unionByName, out), seconds


def populations(settings: dict[str, Config]) -> list[tuple[Config, dict[str, dict[str, float]]]]:
    """Settings by all but their weights: (config, setting -> weights); weights below zero can't be folded and stand alone."""
    out: list[tuple[Config, dict[str, dict[str, float]]]] = []
    for name, config in settings.items():
        base, weights = config.but(feature_weight_overrides={}), config.weights()
        group = next((g for c, g in out if c == base and min(*weights.values(), *(w for o in g.values() for w in o.values())) >= 0), None)
        if group is None:
            out.append((base, group := {}))
        group[name] = weights
    return out


def summary(results: DataFrame) -> DataFrame:
    """-> (setting, class, mean_case_accuracy, pooled_accuracy, median_accuracy)"""
    return evaluate.accuracy_summary(results, ["setting", "class"])


def table(results: DataFrame, settings: list[str], kind: str = "all") -> DataFrame:
    """A row per case and a column per setting, then rows with the three summaries; ready for CSV."""
    own = results.filter(F.col("class") == kind)
    cases = own.groupBy("case_id").pivot("setting", settings).agg(F.first("accuracy"))
    short = summary(own)
    rows = [short.groupBy(F.lit(n).alias("case_id")).pivot("setting", settings).agg(F.first(n)) for n in ("mean_case_accuracy", "pooled_accuracy", "median_accuracy")]
    return reduce(DataFrame.unionByName, [cases, *rows])


def unmatched(models: DataFrame, texts: DataFrame, truth: DataFrame) -> DataFrame:
    """-> (case_id, has_model, has_text, has_truth) of the cases that lack one of them."""
    marks = [df.select("case_id").distinct().withColumn(n, F.lit(True)) for df, n in ((models, "has_model"), (texts, "has_text"), (truth, "has_truth"))]
    whole = reduce(lambda a, b: a.join(b, "case_id", "full"), marks).na.fill(False)
    return whole.filter(~(F.col("has_model") & F.col("has_text") & F.col("has_truth")))


def fitness(models: DataFrame, texts: DataFrame, truth: DataFrame, config: Config):
    """The pooled accuracies of a whole population of weights in one job, for optimize.search."""

    def of(population: list[dict[str, float]]) -> list[float]:
        results, _ = run_benchmark(models, texts, truth, {str(i): config.but(feature_weight_overrides=w) for i, w in enumerate(population)})
        found = {r["setting"]: r["pooled_accuracy"] for r in summary(results).filter("class = 'all'").collect()}
        return [found.get(str(i)) or 0.0 for i in range(len(population))]

    return of
