"""Predicate and argument tables, and patterns over constituent trees: joins of places with intervals.

Sentences are (case_id, sent_id). Tokens have a place tok_id; an argument covers the tokens from_tok to to_tok. A node of a
tree is numbered in preorder (`node`), and `last` is the largest number below it, so that its descendants are an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import content_tokens
from .graph import checkpointed

#: Verb forms of predicates that count; predicates of nouns and gerunds don't.
PREDICATE_VFORMS = ("personal", "participle", "infinitive")
_SENTENCE = ["case_id", "sent_id"]


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, first: str, last: str, width: int = 16) -> DataFrame:
    """Rows of points with every interval of the same keys that holds their point (both ends included).

    An equi-join on (keys, bin): an interval is dealt to each bin of `width` places that it touches, a point to one bin, so
    that each pair meets once and neither a long sentence nor a popular key meets itself in full. Nulls and intervals that
    end before they begin join nothing.
    """
    bins = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
    dealt = intervals.filter(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(bins))
    met = points.withColumn("_bin", F.floor(F.col(point) / width)).join(dealt, [*keys, "_bin"])
    return met.filter(F.col(point).between(F.col(first), F.col(last))).drop("_bin")


def relevant_predicates(predicates: DataFrame, tokens: DataFrame) -> DataFrame:
    """predicates(case_id, sent_id, pred_id, head_tok) whose head is a verb in one of PREDICATE_VFORMS."""
    heads = tokens.filter((F.col("pos") == "verb") & F.col("vform").isin(*PREDICATE_VFORMS)).select(*_SENTENCE, F.col("tok_id").alias("head_tok")).distinct()
    return predicates.join(heads, [*_SENTENCE, "head_tok"], "left_semi").select(*_SENTENCE, "pred_id", "head_tok")


def with_predicates(tokens: DataFrame, predicates: DataFrame) -> DataFrame:
    """tokens with is_predicate true on the heads of relevant predicates and nowhere else."""
    heads = relevant_predicates(predicates, tokens).select(*_SENTENCE, F.col("head_tok").alias("tok_id"), F.lit(True).alias("_head")).distinct()
    return tokens.drop("is_predicate").join(heads, [*_SENTENCE, "tok_id"], "left").withColumn("is_predicate", F.coalesce("_head", F.lit(False))).drop("_head")


def role_tokens(predicates: DataFrame, arguments: DataFrame, tokens: DataFrame) -> DataFrame:
    """arguments(case_id, sent_id, pred_id, role, head_tok, from_tok, to_tok) -> tokens once for each role they have.

    Rows have the columns of tokens with role, is_head and in_role: a content word of an argument has in_role, its head
    is_head. Arguments of predicates that do not count give none. A token may have several roles, and be the head in one
    and a plain word in another; repeated arguments give it once.
    """
    content = content_tokens(tokens).drop("role", "is_head")
    own = arguments.join(relevant_predicates(predicates, tokens).select(*_SENTENCE, "pred_id").distinct(), [*_SENTENCE, "pred_id"], "left_semi")
    inside = range_join(content.select(*_SENTENCE, "tok_id"), own.select(*_SENTENCE, "role", "from_tok", "to_tok"), _SENTENCE, "tok_id", "from_tok", "to_tok")
    heads = own.select(*_SENTENCE, F.col("head_tok").alias("tok_id"), "role", F.lit(True).alias("is_head"), F.lit(False).alias("in_role"))
    marks = inside.select(*_SENTENCE, "tok_id", "role", F.lit(False).alias("is_head"), F.lit(True).alias("in_role")).unionByName(heads)
    once = marks.groupBy(*_SENTENCE, "tok_id", "role").agg(F.max("is_head").alias("is_head"), F.max("in_role").alias("in_role"))
    return content.join(once, [*_SENTENCE, "tok_id"])


def condition_tokens(nodes: DataFrame) -> DataFrame:
    """nodes(case_id, sent_id, node, last, parent, nth, label, tok_id, word) -> (case_id, sent_id, tok_id) of conditions.

    A condition is what follows the opening "if" of a clause: a "claus" that opens with an "adv" over "if", or a "sub-cl"
    that opens with "if" itself. It ends with the clause or at its first "sf-brk". nth counts children from 0; leaves alone
    have tok_id and word. Nested and repeated clauses give a token once.
    """
    tree = _SENTENCE
    named = nodes.select(*tree, *[F.col(c).alias(f"c_{c}") for c in ("node", "last", "label")])
    says_if = (F.lower("word") == "if") & (F.col("nth") == 0)
    word = nodes.filter(says_if).select(*tree, F.col("parent").alias("_own"), F.col("last").alias("_end"))
    direct = named.filter("c_label = 'sub-cl'").join(word.withColumnRenamed("_own", "c_node"), [*tree, "c_node"])
    adverb = nodes.filter("label = 'adv' and nth = 0").select(*tree, F.col("node").alias("_own"), F.col("last").alias("_stop"), F.col("parent").alias("c_node"))
    above = named.filter("c_label = 'claus'").join(adverb, [*tree, "c_node"]).join(word.drop("_end"), [*tree, "_own"])
    opened = direct.select(*tree, "c_node", (F.col("_end") + 1).alias("first"), F.col("c_last").alias("until")).unionByName(above.select(*tree, "c_node", (F.col("_stop") + 1).alias("first"), F.col("c_last").alias("until")))
    below = range_join(nodes.select(*tree, "node", "label", "tok_id"), opened.distinct(), tree, "node", "first", "until")
    stop = F.min(F.when(F.col("label") == "sf-brk", F.col("node"))).over(Window.partitionBy(*tree, "c_node"))
    kept = below.withColumn("_stop", stop).filter("tok_id is not null and (_stop is null or node < _stop)")
    return kept.select(*tree, "tok_id").distinct()


def with_conditions(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """tokens with in_condition true on the tokens of conditions and nowhere else."""
    found = condition_tokens(nodes).withColumn("_in", F.lit(True))
    return tokens.drop("in_condition").join(found, [*_SENTENCE, "tok_id"], "left").withColumn("in_condition", F.coalesce("_in", F.lit(False))).drop("_in")


def ancestors(parents: DataFrame, keys: list[str], most_rounds: int = 40) -> DataFrame:
    """parents(keys, node, parent; null at roots) -> (keys, node, root, depth) by pointer jumping.

    Every pointer is replaced by the pointer's pointer, so that paths halve each round: as many rounds as the logarithm of
    the deepest tree. A node whose parent is no node of the table is pointed at as root. Cycles are an error.
    """
    now = checkpointed(parents.select(*keys, "node", F.coalesce("parent", "node").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(most_rounds):
        up = now.select(*keys, F.col("node").alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_more"))
        moved = now.join(up, [*keys, "root"], "left").select(*keys, "node", F.coalesce("_up", "root").alias("root"), (F.col("depth") + F.when(F.col("_up") != F.col("root"), F.col("_more")).otherwise(0)).alias("depth"), (F.col("_up") != F.col("root")).alias("_moved"))
        now = checkpointed(moved)
        if not now.filter("_moved").head(1):
            return now.drop("_moved")
        now = now.drop("_moved")
    raise ValueError("the pointers run in a circle")
