"""Label grammar: charts of all labels at once by joins, and the best sequences of tags.

A grammar is a table. Rules are cut into pairs, chains of single symbols are closed beforehand, and items
(keys, symbol, i, j) are joined where one ends and the next begins, until nothing new comes.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import checkpointed

Rules = dict[str, list[tuple[str, ...]]]

#: The grammar of activity labels over tags: VB verb, NN noun, NNA noun that names an action, JJ, VBN, VBG, DT, PRP, IN,
#: TO, RP, RB, CC.
LABELS: Rules = {
    "double-action": [(a, "CC", b) for a in ("action", "noun-action") for b in ("action", "noun-action")],
    "action": [("verb-phrase",), ("verb-phrase", "rest"), ("action", "RB")],
    "rest": [("noun-phrase",), ("prep-phrase",), ("noun-phrase", "prep-phrase"), ("noun-phrase", "infinitive"), ("prep-phrase", "prep-phrase")],
    "verb-phrase": [("VB",), ("VB", "RP")],
    "infinitive": [("TO", "VB"), ("TO", "VB", "noun-phrase")],
    "noun-action": [("action-nouns",), ("action-nouns", "prep-phrase")],
    "action-nouns": [("NNA",)] + [(t, "action-nouns") for t in ("DT", "NN", "JJ", "VBN", "VBG")],
    "noun-phrase": [("nouns",), ("PRP",), ("noun-phrase", "CC", "noun-phrase")],
    "nouns": [("NN",), ("NNA",), ("JJ",), ("VBG",)] + [(t, "nouns") for t in ("DT", "NN", "NNA", "JJ", "VBN", "VBG")],
    "prep-phrase": [("IN", "noun-phrase"), ("TO", "noun-phrase")],
}
#: What a label can be as a whole, the preferred first.
TOPS = ("noun-action", "double-action", "action", "noun-phrase")


def pairs(rules: Rules) -> list[tuple[str, str, str]]:
    """(symbol, left, right): rules of two symbols; longer ones through symbols of their own for what is left."""
    out = []
    for symbol, bodies in rules.items():
        for body in bodies:
            own = symbol
            while len(body) > 2:
                rest = "+".join(body[1:])
                out.append((own, body[0], rest))
                own, body = rest, body[1:]
            if len(body) == 2:
                out.append((own, *body))
    return sorted(set(out))


def singles(rules: Rules) -> list[tuple[str, str]]:
    """(symbol, part) for every chain of rules of one symbol, each symbol with itself."""
    symbols = {*rules, *chain.from_iterable(chain.from_iterable(rules.values())), *(p[0] for p in pairs(rules))}
    up = {(s, s) for s in symbols}
    step = {(s, body[0]) for s, bodies in rules.items() for body in bodies if len(body) == 1}
    while more := {(a, d) for a, b in step for c, d in up if b == c} - up:
        up |= more
    return sorted(up)


def parse(tags: DataFrame, keys: list[str], rules: Rules = LABELS, most_rounds: int = 200) -> DataFrame:
    """tags(keys, at from 0, tag; several for a place where the tagger is not sure) -> chart(keys, symbol, i, j), j exclusive.

    Semi-naive: what a round finds meets the whole chart on its left and on its right, and only what is new goes on, for
    all labels in the same joins. A round is one shuffle by (keys, place); labels of n words end after n rounds at most.
    """
    spark = tags.sparkSession
    up = spark.createDataFrame(singles(rules), "symbol string, part string")
    found = pairs(rules)
    above: dict[str, list[str]] = {}
    for symbol, part in singles(rules):
        above.setdefault(part, []).append(symbol)
    closed = spark.createDataFrame([(s, a, b) for own, a, b in found for s in above[own]], "symbol string, left string, right string")
    leaves = tags.select(*keys, F.col("tag").alias("part"), F.col("at").cast("int").alias("i"), (F.col("at") + 1).cast("int").alias("j"))
    held = leaves.join(up, "part").select(*keys, "symbol", "i", "j")
    own = leaves.select(*keys, F.col("part").alias("symbol"), "i", "j")  # tags that no rule names stay as they are
    seen = new = checkpointed(held.unionByName(own).distinct())
    for _ in range(most_rounds):

        def met(lefts: DataFrame, rights: DataFrame) -> DataFrame:
            begun = lefts.withColumnRenamed("symbol", "left").join(closed, "left").select(*keys, "symbol", "right", "i", F.col("j").alias("_at"))
            ended = rights.select(*keys, F.col("symbol").alias("right"), F.col("i").alias("_at"), "j")
            return begun.join(ended, [*keys, "right", "_at"]).select(*keys, "symbol", "i", "j")

        new = checkpointed(met(new, seen).unionByName(met(seen, new)).distinct().join(seen, [*keys, "symbol", "i", "j"], "left_anti"))
        if not new.head(1):
            return seen
        seen = seen.unionByName(new)
    raise ValueError(f"a label needs more than {most_rounds} rounds")


def tops(chart: DataFrame, lengths: DataFrame, keys: list[str], wanted: tuple[str, ...] = TOPS) -> DataFrame:
    """lengths(keys, n) -> (keys, top): the preferred symbol over the whole label, null without one."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("symbol"))
    whole = chart.filter("i = 0").join(lengths, keys).filter("j = n").filter(place > 0).groupBy(*keys).agg(F.min(place).alias("_p"))
    return lengths.join(whole, keys, "left").select(*keys, F.get(F.array(*map(F.lit, wanted)), F.col("_p").cast("int") - 1).alias("top"))


def parts(chart: DataFrame, whole: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """-> (keys, part, i, j): predicate and object of labels whose top is an action or a noun-action.

    An action's predicate is its verb phrase, the longest where several fit; its object the longest noun phrase right
    after it that leaves nothing or a phrase that may stand there. A noun-action's predicate is the last of its action nouns; its
    object what stands before, or else the noun phrase of a following preposition.
    """
    sized = whole.join(lengths, keys)
    c = chart.select(*keys, "symbol", F.col("i").alias("a"), F.col("j").alias("b"))
    fits = c.filter("symbol = 'rest'").select(*keys, F.col("a").alias("k"), F.col("b").alias("n"))
    verb = sized.filter("top = 'action'").join(c.filter("symbol = 'verb-phrase' and a = 0"), keys).withColumn("k", F.col("b"))
    closed = verb.filter("k = n").select(*keys, "k", "n").unionByName(verb.select(*keys, "k", "n").join(fits, [*keys, "k", "n"]))
    chosen = closed.groupBy(*keys).agg(F.max("k").alias("k"), F.first("n").alias("n"))
    noun = chosen.join(c.filter("symbol = 'noun-phrase'").select(*keys, F.col("a").alias("k"), F.col("b").alias("e")), [*keys, "k"])
    after = c.filter("symbol in ('prep-phrase', 'infinitive')").select(*keys, F.col("a").alias("e"), F.col("b").alias("n"))
    ends = noun.filter("e = n").select(*keys, "k", "e").unionByName(noun.join(after, [*keys, "e", "n"]).select(*keys, "k", "e"))
    object_ = ends.groupBy(*keys, "k").agg(F.max("e").alias("e")).select(*keys, F.lit("object").alias("part"), F.col("k").alias("i"), F.col("e").alias("j"))
    acts = sized.filter("top = 'noun-action'").join(c.filter("symbol = 'action-nouns' and a = 0"), keys).groupBy(*keys).agg(F.max("b").alias("e"), F.first("n").alias("n"))
    of = c.filter("symbol = 'noun-phrase'").select(*keys, (F.col("a") - 1).alias("e"), F.col("b").alias("n"))
    named = acts.filter("e > 1").select(*keys, F.lit("object").alias("part"), F.lit(0).alias("i"), (F.col("e") - 1).alias("j"))
    follows = acts.filter("e = 1").join(of, [*keys, "e", "n"]).select(*keys, F.lit("object").alias("part"), (F.col("e") + 1).alias("i"), F.col("n").alias("j"))
    said = chosen.select(*keys, F.lit("predicate").alias("part"), F.lit(0).alias("i"), F.col("k").alias("j"))
    noun_said = acts.select(*keys, F.lit("predicate").alias("part"), (F.col("e") - 1).alias("i"), F.col("e").alias("j"))
    return said.unionByName(object_).unionByName(noun_said).unionByName(named).unionByName(follows)


def k_best(lattice: Column, transitions: dict[tuple[str, str], int], k: int, missing: int = -1_000_000) -> Column:
    """array<struct<cost, path, last>>: the k best sequences of tags, cheapest first, ties by path.

    lattice: array<array<struct<tag string, score bigint>>>, a place's possible tags with whole-number scores (scaled logarithms);
    transitions: scores of neighbouring tags, "^" before the first. Dynamic programming as a fold over the places: the k best
    sequences that end in each tag are kept, so that none of the k best overall is lost. A place without tags ends all.
    """
    scores = F.create_map(*chain.from_iterable((F.lit(f"{a} {b}"), F.lit(s).cast("bigint")) for (a, b), s in transitions.items()))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("path"), F.lit("^").alias("last")))

    def step(states: Column, places: Column) -> Column:
        def to(tag: Column) -> Column:
            def after(s: Column) -> Column:
                move = F.coalesce(F.try_element_at(scores, F.concat_ws(" ", s["last"], tag["tag"])), F.lit(missing).cast("bigint"))
                return F.struct((s["cost"] - tag["score"] - move).alias("cost"), F.ltrim(F.concat_ws(" ", s["path"], tag["tag"])).alias("path"), tag["tag"].alias("last"))

            return F.slice(F.array_sort(F.transform(states, after)), 1, k)

        return F.flatten(F.transform(places, to))

    return F.slice(F.array_sort(F.aggregate(lattice, start, step)), 1, k)


def tag_rules(spark: SparkSession, rules: Rules = LABELS) -> DataFrame:
    """The grammar as a table (symbol, left, right), right null in rules of one symbol."""
    rows: Iterable[tuple] = [*pairs(rules), *((s, b[0], None) for s, bodies in rules.items() for b in bodies if len(b) == 1)]
    return spark.createDataFrame(list(rows), "symbol string, left string, right string")
