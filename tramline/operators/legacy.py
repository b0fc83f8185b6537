"""Tools around ground truths and files: closest strings, id patches, editor files, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bag_distance, base_name


def closest(names: DataFrame, known: DataFrame, case: str = "case_id") -> DataFrame:
    """names(case, name), known(case, id, label) -> (case, name, id, distance) by the least bag-of-characters distance within the case; ties to the smaller id."""
    pairs = names.select(case, "name").distinct().join(known.select(case, "id", "label"), case)
    scored = pairs.withColumn("distance", bag_distance(F.col("name"), F.col("label")))
    best = scored.groupBy(case, "name").agg(F.min(F.struct("distance", "id")).alias("_b"))
    return best.select(case, "name", "_b.id", "_b.distance")


def patched(names: DataFrame, known: DataFrame, patches: DataFrame, case: str = "case_id") -> DataFrame:
    """closest, where a patch(case, name, id) decides first."""
    fixed = patches.select(case, "name", F.col("id").alias("_id"))
    return closest(names, known, case).join(fixed, [case, "name"], "left").select(case, "name", F.coalesce("_id", "id").alias("id"))


def best_file(files: DataFrame, wanted: list[str]) -> DataFrame:
    """files(path) -> (case_id, path): for each wanted name the file whose name has the least edit distance, ties to the smaller path."""
    pairs = files.select("path", base_name(F.col("path")).alias("_n"), F.explode(F.array(*map(F.lit, wanted))).alias("case_id"))
    best = pairs.groupBy("case_id").agg(F.min(F.struct(F.levenshtein("_n", "case_id").alias("d"), "path")).alias("_b"))
    return best.select("case_id", F.col("_b.path").alias("path"))


def editor_alignment(files: DataFrame) -> DataFrame:
    """files(case_id, json: {"sentence id": ["element id", ...]}) -> (case_id, sent_id, elem_id)"""
    rows = files.select("case_id", F.explode(F.from_json("json", "map<string,array<string>>")).alias("sent", "_e"))
    return rows.select("case_id", F.expr("try_cast(sent as int)").alias("sent_id"), F.explode("_e").alias("elem_id"))


def export_ground_truth(truth: DataFrame, sizes: DataFrame) -> DataFrame:
    """(case_id, elem_id, sent_id, err), (case_id, n) -> (case_id, json) in the ground-truth format, elements in order of id."""
    value = F.coalesce(F.col("sent_id").cast("string"), F.lit("no-match"))
    g = truth.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("elem_id", value.alias("v"), "err"))).alias("_a"))
    pairs = lambda f, c: F.map_from_entries(F.transform(F.filter("_a", c), f))
    body = F.struct(
        F.transform("_a", lambda x: x["elem_id"]).alias("tasks"),
        F.col("n").alias("num-sentences"),
        pairs(lambda x: F.struct(x["elem_id"], x["v"]), lambda x: F.lit(True)).alias("alignment"),
        pairs(lambda x: F.struct(x["elem_id"], x["err"]), lambda x: x["err"].isNotNull()).alias("errors"),
    )
    return g.join(sizes, "case_id").select("case_id", F.to_json(body).alias("json"))


def agreement(a: DataFrame, b: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, elem_id, sent_id) twice -> (case, n_ok, n_not_ok, n_total, said): counts and a line of text."""
    both = a.select(case, "elem_id", F.col("sent_id").alias("_a")).join(b.select(case, "elem_id", F.col("sent_id").alias("_b")), [case, "elem_id"])
    same = F.col("_a").eqNullSafe(F.col("_b"))
    out = both.groupBy(case).agg(F.count_if(same).alias("n_ok"), F.count_if(~same).alias("n_not_ok"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("said", F.format_string("%d of %d agree, %d differ", "n_ok", "n_total", "n_not_ok"))


def drop_features(features: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Features left after dropping about `share` of them, by hash and so the same each time."""
    u = F.pmod(F.xxhash64(F.lit(seed), *features.columns), F.lit(1_000_000)) / 1_000_000
    return features.filter(u >= share)


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
