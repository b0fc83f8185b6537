"""Assignments of elements to sentences, with and without order constraints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DUMMY_SENTENCE, DUMMY_SIMILARITY
from . import solver

#: Elements times sentences of a case; a case is one model and its text.
MOST_CELLS = 4_000_000


def constrained_alignment(sims: DataFrame, elements: DataFrame, before: DataFrame, case: str = "case_id", anchors: bool = False, restrict: bool = True, closed: DataFrame | None = None) -> DataFrame:
    """-> (case, elem_id, sent_id, sim).

    sims(case, sent_id, elem_id, sim) is dense for real sentences, elements(case, elem_id, is_gateway), before(case, src, dst).
    closed(case, src, dst), if given: gateways src that are not to come after dst, which follows their closing gateway.
    A case is one small optimisation problem of at most MOST_CELLS similarities, solved to the proven optimum in its own
    task; cases run in parallel. Ties take the smaller sentence. A larger case, and one that allows nothing, is an error.
    """
    kinds = dict(sims.dtypes)
    dummy = DUMMY_SIMILARITY if anchors else None
    gates = elements.select(case, "elem_id", F.col("is_gateway").cast("boolean").alias("is_gateway"))
    rows = sims.join(gates, [case, "elem_id"]).groupBy(case).agg(F.collect_list(F.struct("elem_id", "sent_id", "sim", "is_gateway")).alias("cells"))
    order = before.groupBy(case).agg(F.collect_list(F.struct("src", "dst")).alias("pairs"))
    shut = before.limit(0) if closed is None else closed
    shut = shut.groupBy(case).agg(F.collect_list(F.struct("src", "dst")).alias("closed"))
    schema = f"{case} {kinds[case]}, elem_id {kinds['elem_id']}, sent_id {kinds['sent_id']}, sim double"

    def solve(batches):
        for pdf in batches:
            out = []
            for key, cells, pairs, closings in zip(pdf[case], pdf["cells"], pdf["pairs"], pdf["closed"]):
                if len(cells) > MOST_CELLS:
                    raise ValueError(f"case {key} has {len(cells)} similarities, more than one task solves")
                elems, sents = sorted({c["elem_id"] for c in cells}), sorted({c["sent_id"] for c in cells})
                at, col = {e: i for i, e in enumerate(elems)}, {s: i for i, s in enumerate(sents)}
                matrix = [[0.0] * len(sents) for _ in elems]
                gateway = [False] * len(elems)
                for c in cells:
                    matrix[at[c["elem_id"]]][col[c["sent_id"]]] = float(c["sim"])
                    gateway[at[c["elem_id"]]] = bool(c["is_gateway"]) and anchors
                links, ends = ([(at[p["src"]], at[p["dst"]]) for p in (given if given is not None and restrict else []) if p["src"] in at and p["dst"] in at] for given in (pairs, closings))
                found = solver.assign(matrix, gateway, links, dummy, ends)
                if found is None:
                    raise ValueError(f"case {key}: the constraints allow no assignment")
                for e, s in zip(elems, found.chosen):
                    out.append((key, e, DUMMY_SENTENCE if s < 0 else sents[s], dummy if s < 0 else matrix[at[e]][s]))
            yield pd.DataFrame(out, columns=[case, "elem_id", "sent_id", "sim"])

    return rows.join(order, case, "left").join(shut, case, "left").mapInPandas(solve, schema)


def unassigned(elements: DataFrame, alignment: DataFrame, case: str, sent: int = DUMMY_SENTENCE) -> DataFrame:
    """alignment and, at sentence `sent`, the elements that it leaves out."""
    left = elements.select(case, "elem_id").join(alignment, [case, "elem_id"], "left_anti")
    return alignment.select(case, "elem_id", "sent_id").union(left.select(case, "elem_id", F.lit(sent)))


def max_constrained(trivial: DataFrame, constrained: DataFrame, case: str, tasks: DataFrame | None = None) -> DataFrame:
    """-> (case, max_constrained): the greatest similarity a task loses to the constraints; null without tasks."""
    pairs = trivial.select(case, "elem_id", F.col("sim").alias("_t")).join(constrained.select(case, "elem_id", F.col("sim").alias("_c")), [case, "elem_id"])
    if tasks is not None:
        pairs = pairs.join(tasks.select(case, "elem_id"), [case, "elem_id"], "left_semi")
    return pairs.groupBy(case).agg(F.max(F.col("_t") - F.col("_c")).alias("max_constrained"))


def correct_order(trivial: DataFrame, constrained: DataFrame, loss: DataFrame, threshold: float, case: str) -> DataFrame:
    """Cases whose greatest loss is over the threshold take the trivial alignment."""
    wrong = loss.filter(F.col("max_constrained") > threshold).select(case)
    kept = [case, "elem_id", "sent_id", "sim"]
    return trivial.select(*kept).join(wrong, case, "left_semi").union(constrained.select(*kept).join(wrong, case, "left_anti"))


def total_score(alignment: DataFrame, n_sents: DataFrame, n_elems: DataFrame, case: str) -> DataFrame:
    """-> (case, total_score): twice the similarity of good matches over the number of sentences and elements; null for an empty case."""
    good = alignment.groupBy(case).agg(F.sum(F.when(F.col("sent_id").isNotNull(), F.col("sim"))).alias("_sum"))
    sizes = n_sents.select(case, F.col("n").alias("_s")).join(n_elems.select(case, F.col("n").alias("_e")), case)
    total = F.nullif(F.col("_s") + F.col("_e"), F.lit(0))
    return sizes.join(good, case, "left").select(case, (2 * F.coalesce("_sum", F.lit(0.0)) / total).alias("total_score"))


def monotone_total_order(sims: DataFrame, case: str, elem_order: str, sent_order: str) -> DataFrame:
    """The constrained optimum where all elements are in a total order, by a running maximum; -> (case, best).

    Each case is folded inside one expression over its sorted similarity rows, without Python.
    """
    row = sims.groupBy(case, elem_order).agg(F.transform(F.sort_array(F.collect_list(F.struct(sent_order, "sim"))), lambda x: x["sim"]).alias("_row"))
    rows = row.groupBy(case).agg(F.transform(F.sort_array(F.collect_list(F.struct(elem_order, "_row"))), lambda x: x["_row"]).alias("_rows"))
    zero = F.transform(F.get("_rows", F.lit(0)), lambda _: F.lit(0.0))

    def step(acc, line):
        # the best with this element at s or before: the running maximum of best before plus own similarity
        add = F.zip_with(acc, line, lambda a, b: a + b)
        run = F.aggregate(add, F.array().cast("array<double>"), lambda out, x: F.concat(out, F.array(F.greatest(x, F.coalesce(F.get(out, F.size(out) - 1), x)))))
        return run

    return rows.select(case, F.element_at(F.aggregate("_rows", zero, step), -1).alias("best"))
