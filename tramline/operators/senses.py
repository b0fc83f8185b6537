"""Word senses: ranks over the hypernym graph, and the best-ranked sense of each token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Parts of speech by the last letter of a sense id.
POS = {"n": "noun", "v": "verb", "a": "adjective", "s": "adjective", "r": "adverb"}


def page_rank(edges: DataFrame, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """edges(child, parent) -> (node, rank): weight flows from child to parent for a fixed number of rounds.

    A node gives its rank in equal parts to its distinct parents; the mass of nodes without parents is spread over all, so
    that ranks add up to 1. A round is one join by child and one combined aggregation by parent; the driver sees the spread
    mass, one number a round. Self-loops count as edges; an empty graph gives no rows.
    """
    links = checkpointed(edges.select("child", "parent").filter("child is not null and parent is not null").distinct())
    out = links.groupBy("child").agg(F.count(F.lit(1)).alias("_n"))
    nodes = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    nodes = checkpointed(nodes.join(out.withColumnRenamed("child", "node"), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = ranks.filter("_n is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = ranks.filter("_n is not null").select(F.col("node").alias("child"), (F.col("rank") / F.col("_n")).alias("_part"))
        got = links.join(given, "child").groupBy(F.col("parent").alias("node")).agg(F.sum("_part").alias("_got"))
        rank = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("_got", F.lit(0.0))
        ranks = checkpointed(nodes.join(got, "node", "left").select("node", "_n", rank.alias("rank")))
    return ranks.select("node", "rank")


def candidates(senses: DataFrame) -> DataFrame:
    """senses(wn, senses array of words) -> (lemma, pos, wn); the part of speech is the id's last letter."""
    kind = F.substring("wn", -1, 1)
    pos = F.coalesce(*(F.when(kind == letter, F.lit(name)) for letter, name in POS.items()))
    return senses.select(F.explode("senses").alias("lemma"), pos.alias("pos"), "wn").filter("pos is not null").distinct()


def best_senses(senses: DataFrame, ranks: DataFrame) -> DataFrame:
    """-> (lemma, pos, wn): the best-ranked sense of each word, ties to the smaller id; senses without a rank come last."""
    each = candidates(senses).join(ranks.withColumnRenamed("node", "wn"), "wn", "left")
    return each.groupBy("lemma", "pos").agg(F.min_by("wn", F.struct((-F.coalesce("rank", F.lit(0.0))).alias("r"), F.col("wn"))).alias("wn"))


def with_senses(tokens: DataFrame, best: DataFrame) -> DataFrame:
    """tokens whose wn is null get the best sense of their (lemma, pos); their own senses stay."""
    found = best.withColumnRenamed("wn", "_wn")
    return tokens.join(found, ["lemma", "pos"], "left").select(*[F.coalesce("wn", "_wn").alias("wn") if c == "wn" else F.col(c) for c in tokens.columns])


def ranked_senses(tokens: DataFrame, keys: list[str], senses: DataFrame, ranks: DataFrame) -> DataFrame:
    """-> (keys, wn, rank, nth): all senses of each token, best first."""
    each = tokens.select(*keys, "lemma", "pos").join(candidates(senses), ["lemma", "pos"]).join(ranks.withColumnRenamed("node", "wn"), "wn", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return each.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rank"), "wn"))).select(*keys, "wn", "rank", "nth")
