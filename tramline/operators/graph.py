"""Order relations and graphs, for all cases at once.

Edges are (case columns..., src, dst). Iterative operators join edges until nothing changes and cut their lineage with
checkpoints in the shared folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROUNDS = 100


def shared_folder(spark) -> str:
    """The session's checkpoint folder: that of spark.checkpoint.dir, or one of our own only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/tramline-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def degrees(edges: DataFrame, case: list[str]) -> DataFrame:
    """-> (case, node, n_in, n_out) in one aggregation over both ends."""
    ends = edges.select(*case, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("_e"))
    return ends.groupBy(*case, F.col("_e.node").alias("node")).agg(F.sum("_e.i").alias("n_in"), F.sum("_e.o").alias("n_out"))


def sentence_order(a: Column, b: Column) -> Column:
    """The relation of two sentence ids; the dummy (negative) is beside all real ones."""
    return F.when(a * b < 0, "||").when(a < b, "->").when(a > b, "<-").otherwise("!=")


def reverse(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def closure(edges: DataFrame, case: list[str], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """-> distinct (case, src, dst) of reachable pairs, by doubling path lengths until the count stands still.

    Doubling needs about log2(longest path) rounds. Cycles are fine: their nodes reach themselves.
    """
    now = checkpointed(edges.select(*case, "src", "dst").distinct())
    n = now.count()
    for _ in range(most_rounds):
        left = now.select(*case, "src", F.col("dst").alias("_m"))
        right = now.select(*case, F.col("src").alias("_m"), "dst")
        now = checkpointed(now.union(left.join(right, [*case, "_m"]).select(*case, "src", "dst")).distinct())
        was, n = n, now.count()
        if n == was:
            return now
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def relations(nodes: DataFrame, reach: DataFrame, case: list[str]) -> DataFrame:
    """All ordered pairs of a case's nodes (case, x, y, rel): -> or <- if one reaches the other, || if both or neither, != for itself."""
    x, y = nodes.select(*case, F.col("node").alias("x")), nodes.select(*case, F.col("node").alias("y"))
    pairs = x.join(y, case) if case else x.crossJoin(y)
    there = reach.select(*case, F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(True).alias("_f"))
    back = reach.select(*case, F.col("src").alias("y"), F.col("dst").alias("x"), F.lit(True).alias("_b"))
    out = pairs.join(there, [*case, "x", "y"], "left").join(back, [*case, "x", "y"], "left")
    rel = F.when(F.col("x") == F.col("y"), "!=").when(F.col("_f") & F.col("_b").isNull(), "->").when(F.col("_b") & F.col("_f").isNull(), "<-").otherwise("||")
    return out.select(*case, "x", "y", rel.alias("rel"))


def merge_message_flows(sequence: DataFrame, flows: DataFrame, case: list[str]) -> DataFrame:
    """The order over processes: the closure over sequence and message edges together."""
    return closure(sequence.select(*case, "src", "dst").union(flows.select(*case, "src", "dst")), case)


def usable_message_flows(flows: DataFrame, case: list[str], elements: DataFrame | None = None) -> DataFrame:
    """flows(case, seq, src, dst) between elements, greedily in file order: a flow goes if an end was seen before, kept or not.

    As dropped flows mark their ends too, a flow stays exactly if it is the first at both ends: two windows, no loop.
    """
    if elements is not None:
        ids = elements.select(*case, "elem_id")
        for end in ("src", "dst"):
            flows = flows.join(ids.withColumnRenamed("elem_id", end), [*case, end], "left_semi")
    ends = flows.select(*case, "seq", F.explode(F.array("src", "dst")).alias("node"))
    first = ends.groupBy(*case, "node").agg(F.min("seq").alias("_first"))
    out = flows
    for end in ("src", "dst"):
        out = out.join(first.withColumnsRenamed({"node": end, "_first": f"_{end}"}), [*case, end])
    return out.filter("seq = _src and seq = _dst").select(*flows.columns)


def dominators(edges: DataFrame, case: str, start: str = "start") -> DataFrame:
    """edges(case, start, src, dst) -> (case, node, dom): every node on all paths from the start to node, itself included.

    Process graphs are small, so each case's graph is solved in its own task; nodes that the start cannot reach are left out.
    """
    kinds = dict(edges.dtypes)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        root, after, before = g[start].iloc[0], {}, {}
        for s, d in zip(g["src"], g["dst"]):
            after.setdefault(s, []).append(d)
            before.setdefault(d, []).append(s)
        order, seen, todo = [], {root}, [root]
        while todo:
            x = todo.pop()
            order.append(x)
            for y in after.get(x, []):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        dom = {x: set(order) for x in order}
        dom[root] = {root}
        for _ in range(len(order) + 1):
            changed = False
            for x in order[1:]:
                new = set.intersection(*[dom[p] for p in before[x] if p in dom]) | {x}
                changed |= new != dom[x]
                dom[x] = new
            if not changed:
                break
        rows = [(g[case].iloc[0], x, d) for x in order for d in dom[x]]
        return pd.DataFrame(rows, columns=[case, "node", "dom"])

    return edges.select(case, start, "src", "dst").groupBy(case).applyInPandas(solve, f"{case} {kinds[case]}, node {kinds['src']}, dom {kinds['src']}")


def back_edges(edges: DataFrame, case: str, start: str = "start") -> DataFrame:
    """Edges whose head dominates their tail."""
    dom = dominators(edges, case, start).select(case, F.col("node").alias("src"), F.col("dom").alias("dst"))
    return edges.join(dom, [case, "src", "dst"], "left_semi")


def acyclic(edges: DataFrame, case: str, start: str = "start") -> DataFrame:
    return edges.join(back_edges(edges, case, start).select(case, "src", "dst"), [case, "src", "dst"], "left_anti")


def levels(edges: DataFrame, case: list[str], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """-> (case, node, level) of an acyclic graph: peel nodes without incoming edges; a node in a cycle has no level."""
    nodes = checkpointed(edges.select(*case, F.explode(F.array("src", "dst")).alias("node")).distinct())
    left, todo, out = checkpointed(edges.select(*case, "src", "dst").distinct()), nodes, []
    for level in range(most_rounds):
        blocked = left.select(*case, F.col("dst").alias("node")).distinct()
        free = checkpointed(todo.join(blocked, [*case, "node"], "left_anti"))
        if not free.head(1):
            break
        out.append(free.withColumn("level", F.lit(level)))
        todo = checkpointed(todo.join(free, [*case, "node"], "left_anti"))
        left = checkpointed(left.join(free.withColumnRenamed("node", "src"), [*case, "src"], "left_anti"))
    else:
        raise RuntimeError(f"more than {most_rounds} levels")
    done = out[0] if out else nodes.withColumn("level", F.lit(0)).limit(0)
    for df in out[1:]:
        done = done.union(df)
    return done


def bypass(edges: DataFrame, gone: DataFrame, case: list[str], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Take the nodes of gone(case, node) out and join their neighbours: an edge for each path through them."""
    now = checkpointed(edges.select(*case, "src", "dst").distinct())
    g_src, g_dst = gone.withColumnRenamed("node", "src"), gone.withColumnRenamed("node", "dst")
    into = checkpointed(now.join(g_dst, [*case, "dst"], "left_semi").select(*case, "src", "dst"))
    out = now.join(g_dst, [*case, "dst"], "left_anti").join(g_src, [*case, "src"], "left_anti").select(*case, "src", "dst")
    inner = now.join(g_src, [*case, "src"], "left_semi").select(*case, F.col("src").alias("_m"), F.col("dst").alias("_to"))
    into = checkpointed(into.join(g_src, [*case, "src"], "left_anti").select(*case, "src", "dst"))
    seen, n = into, into.count()
    for _ in range(most_rounds):
        step = seen.join(inner, (seen["dst"] == inner["_m"]) & _same(seen, inner, case)).select(*[seen[c] for c in case], "src", F.col("_to").alias("dst"))
        seen = checkpointed(seen.union(step).distinct())
        was, n = n, seen.count()
        if n == was:
            break
    else:
        raise RuntimeError(f"paths through what is taken out do not end within {most_rounds} steps")
    through = seen.join(g_dst, [*case, "dst"], "left_anti").select(*case, "src", "dst")
    return out.union(through).distinct()


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & (a[c] == b[c])
    return test


def starts_and_ends(elements: DataFrame, edges: DataFrame, process: list[str]) -> DataFrame:
    """-> (process, n_starts, n_ends, valid): strict models have one start event and an element without outgoing flow."""
    out = edges.groupBy(*process, F.col("src").alias("elem_id")).agg(F.count(F.lit(1)).alias("n_out"))
    joined = elements.join(out, [*process, "elem_id"], "left")
    counts = joined.groupBy(*process).agg(F.count_if(F.col("tag") == "startEvent").alias("n_starts"), F.count_if(F.col("n_out").isNull()).alias("n_ends"))
    return counts.withColumn("valid", (F.col("n_starts") == 1) & (F.col("n_ends") >= 1))


def sese_pairs(edges: DataFrame, gateways: DataFrame, case: str, start: str = "start") -> DataFrame:
    """-> (case, open, close): a split gateway with its closest post-dominating join gateway (gateways: case, elem_id)."""
    forward = edges.select(case, start, "src", "dst")
    nodes = forward.select(case, F.col("dst").alias("node")).distinct()
    ends = nodes.join(forward.select(case, F.col("src").alias("node")).distinct(), [case, "node"], "left_anti")
    sink = ends.select(case, F.lit("\u0000end").alias(start), F.lit("\u0000end").alias("src"), F.col("node").alias("dst"))
    back = forward.select(case, F.lit("\u0000end").alias(start), F.col("dst").alias("src"), F.col("src").alias("dst")).union(sink)
    post = dominators(back, case, start)
    deg = degrees(edges, [case]).join(gateways.select(case, F.col("elem_id").alias("node")), [case, "node"], "left_semi")
    opens, closes = deg.filter("n_out > 1").select(case, "node"), deg.filter("n_in > 1").select(case, F.col("node").alias("dom"))
    pairs = post.filter("node <> dom").join(opens, [case, "node"]).join(closes, [case, "dom"], "left_semi")
    depth = post.groupBy(case, "node").agg(F.count(F.lit(1)).alias("_d")).withColumnRenamed("node", "dom")
    near = Window.partitionBy(case, "node").orderBy(F.desc("_d"), "dom")
    return pairs.join(depth, [case, "dom"]).withColumn("_r", F.row_number().over(near)).filter("_r = 1").select(case, F.col("node").alias("open"), F.col("dom").alias("close"))
