"""Registered queries of populations of weights, extended ground truths, legacy files and snapshots, with their SQL.

Conversations are cases, their words features of two families; nations are cases of a legacy file, customers its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, features, graph, similarity
from ..sources import history, readers
from .engine_queries import _SQL, _tables
from .queries import _r, _read, _SIM_SQL, query

# ---------------------------------------------------------------- populations

_FAMILIES = ("has-form", "has-lemma")
_SETTINGS = {"even": (1.0, 1.0), "forms": (3.0, 0.5), "lemmas": (0.0, 2.0), "none": (0.0, 0.0)}


def _words(spark, sf_dir, role: str, owner: str) -> DataFrame:
    """A turn's words, weighed by their length, and their first two letters as lemmas."""
    turns = _read(spark, sf_dir, "conversations").filter(F.col("role") == role)
    words = turns.select("conv_id", F.col("turn").alias(owner), F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    kinds = [words.select("conv_id", owner, F.lit(f).alias("ftype"), a.alias("arg"), (F.length("w") / 8).alias("weight")) for f, a in zip(_FAMILIES, (F.col("w"), F.substring("w", 1, 2)))]
    return features.union_features(*kinds, ["conv_id", owner])


_POPULATION = f"""WITH wd AS (SELECT conv_id, turn, role, w FROM (SELECT conv_id, turn, role, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM conversations) WHERE w <> ''),
ft AS (SELECT conv_id, turn, role, 'f' AS ftype, w AS arg, max(length(w) / 8) AS x FROM wd GROUP BY ALL UNION ALL SELECT conv_id, turn, role, 'l', substr(w, 1, 2), max(length(w) / 8) FROM wd GROUP BY ALL),
st(setting, f, l) AS (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in _SETTINGS.items())}),
fw AS (SELECT setting, conv_id, turn, role, ftype, arg, x * CASE ftype WHEN 'f' THEN f ELSE l END AS w FROM ft CROSS JOIN st),
al AS (SELECT setting, conv_id, turn, role, count(*) AS n, sum(w) AS w, sqrt(sum(w * w)) AS l2 FROM fw GROUP BY ALL),
bo AS (SELECT t.setting, t.conv_id, t.turn AS sent_id, m.turn AS elem_id, t.w AS tw, m.w AS mw FROM fw t JOIN fw m ON t.setting = m.setting AND t.conv_id = m.conv_id AND t.ftype = m.ftype AND t.arg = m.arg WHERE t.role = 'user' AND m.role = 'assistant'),
pairs AS (SELECT b.setting, b.conv_id, sent_id, elem_id, count(*) AS n_i, sum(CASE WHEN t.n <= m.n THEN tw ELSE mw END) AS w_i, sum(least(tw, mw)) AS w_min, sum(tw * mw) AS dot, any_value(t.n) AS t_n, any_value(t.w) AS t_w, any_value(t.l2) AS t_l2, any_value(m.n) AS m_n, any_value(m.w) AS m_w, any_value(m.l2) AS m_l2
  FROM bo b JOIN al t ON t.role = 'user' AND t.setting = b.setting AND t.conv_id = b.conv_id AND t.turn = sent_id JOIN al m ON m.role = 'assistant' AND m.setting = b.setting AND m.conv_id = b.conv_id AND m.turn = elem_id GROUP BY b.setting, b.conv_id, sent_id, elem_id)"""


def _population(spark, sf_dir, function: str) -> DataFrame:
    sums = similarity.family_sums(_words(spark, sf_dir, "user", "sent_id"), _words(spark, sf_dir, "assistant", "elem_id"), _FAMILIES, ["conv_id"])
    return similarity.weigh(sums, {k: dict(zip(_FAMILIES, w)) for k, w in _SETTINGS.items()}, function, _FAMILIES, ["conv_id"])


def _register(function: str) -> None:
    @query(f"population_{function.replace('-', '_')}", f"{_POPULATION} SELECT setting, conv_id, sent_id, elem_id, round({_SIM_SQL[function]}, 6)::DOUBLE AS sim FROM pairs")
    def run(spark, sf_dir):
        return _population(spark, sf_dir, function).select("setting", "conv_id", "sent_id", "elem_id", _r("sim").alias("sim"))


for _name in ("cosine", "weighted-fake-jaccard", "weighted-jaccard"):
    _register(_name)


# Each assistant turn answers the user's turn before it. Ties go to the smaller turn.
@query("population_fitness", f"""{_POPULATION}, si AS (SELECT setting, conv_id, sent_id, elem_id, round({_SIM_SQL["weighted-jaccard"]}, 9) AS sim FROM pairs),
be AS (SELECT setting, conv_id, elem_id, sent_id, row_number() OVER (PARTITION BY setting, conv_id, elem_id ORDER BY sim DESC, sent_id) AS nth FROM si),
pc AS (SELECT setting, conv_id, count(*) FILTER (WHERE sent_id = elem_id - 1) AS ok, count(*) AS n FROM be WHERE nth = 1 GROUP BY setting, conv_id)
SELECT setting, round(avg(ok / n), 6) AS mean_case_accuracy, round(sum(ok) / sum(n), 6) AS pooled_accuracy, round(median(ok / n), 6) AS median_accuracy FROM pc GROUP BY setting""")
def population_fitness(spark, sf_dir):
    """The accuracies of a whole population of weights, in one job."""
    sims = _population(spark, sf_dir, "weighted-jaccard").withColumn("sim", _r("sim", 9))
    best = sims.groupBy("setting", "conv_id", "elem_id").agg(F.max_by("sent_id", F.struct("sim", -F.col("sent_id"))).alias("sent_id"))
    case = F.struct("setting", "conv_id").alias("case_id")
    none = F.lit(None).cast("string").alias("err")
    guess, truth = (best.select(case, "elem_id", s.alias("sent_id"), none) for s in (F.col("sent_id"), F.col("elem_id") - 1))
    scored = evaluate.accuracy_by_class(evaluate.compare(guess, truth), best.select(case, "elem_id", F.lit("turn").alias("class"))).filter("class = 'all'")
    out = evaluate.accuracy_summary(scored.withColumn("setting", F.col("case_id.setting")), ["setting"])
    return out.select("setting", *[_r(c).alias(c) for c in ("mean_case_accuracy", "pooled_accuracy", "median_accuracy")])


# ---------------------------------------------------------------- ground truths


@query("extended_ground_truth", f"""{_SQL}, dg AS (SELECT case_id, node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT case_id, src AS node, 0 AS i, 1 AS o FROM ed UNION ALL SELECT case_id, dst, 1, 0 FROM ed) GROUP BY case_id, node),
sz AS (SELECT case_id, count(*) AS n FROM se GROUP BY case_id)
SELECT el.case_id, el.elem_id, lower(elem_type) AS class, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 9 ELSE -1 END::INTEGER AS sent_id, CASE WHEN p_partkey % 5 = 3 THEN 'm' END AS err, coalesce(sz.n, 0)::BIGINT AS n_sents
FROM el LEFT JOIN dg ON dg.case_id = el.case_id AND dg.node = el.elem_id LEFT JOIN sz ON sz.case_id = el.case_id
WHERE elem_type = 'Task' OR elem_type = 'Event' OR (elem_type = 'Gateway' AND n_in = 1 AND n_out >= 1)""")
def extended_ground_truth(spark, sf_dir):
    """Tasks, split gateways and named events with their sentence (-1: none); one in five is missing, one in five not aligned at all."""
    t = _tables(spark, sf_dir)
    key = F.col("elem_id").cast("long")
    aligned = t["elements"].filter(key % 5 < 4).select("case_id", "elem_id", F.when(key % 5 < 3, key % 9 + 1).cast("int").alias("sent_id"))
    sentences = t["tokens"].select("case_id", "sent_id").distinct()
    return evaluate.extended_structure(aligned, t["elements"], t["edges"], sentences).fillna(-1, ["sent_id"])


def _legacy_lines(spark, sf_dir) -> DataFrame:
    """A file for each nation. Its n customers are tasks, the first seven have a sentence; odd nations lose their fifth id."""
    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("case_id"), "c_custkey", "c_name", F.row_number().over(own).alias("k"), (F.col("c_nationkey") % 2 == 1).alias("odd"))
    gone = F.col("odd") & (F.col("k") == 5)
    number = F.when(F.col("c_custkey") % 3 == 0, "none").otherwise((F.col("k") % 4).cast("string"))
    error = F.when(F.col("c_custkey") % 3 == 0, "m").otherwise("")
    said = [F.when(F.col("k") < 8, x).otherwise("") for x in (F.col("k").cast("string"), F.concat(F.lit("said "), "c_name"))]
    task = F.concat_ws(";", F.when(gone, "").otherwise(F.col("c_custkey").cast("string")), F.concat(F.lit('"'), "c_name", F.lit('; task"')), number, error, F.lit(""), *said)
    below = F.lit(1_000_000_000)
    fixed = c.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("no"), F.lit(x).alias("line")) for n, x in ((0, "id;task;sentence;error;;id;said"), (10**9, ";;;;;;"), (10**9 + 1, "1;outside;1;;;1;outside"), (10**9 + 2, "Original text"))])).alias("x")).select("case_id", "x.*")
    text = c.filter("k <> 3 or not odd").select("case_id", (below + 2 + F.col("k")).alias("no"), F.concat(F.lit("Text of "), "c_name").alias("line"))
    return c.select("case_id", F.col("k").alias("no"), task.alias("line")).unionByName(fixed).unionByName(text)


_LEGACY = """WITH c AS (SELECT c_nationkey AS n, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)"""


@query("legacy_tasks", f"{_LEGACY} SELECT n::VARCHAR AS case_id, c_custkey::INTEGER AS task_id, c_name || '; task' AS task, CASE WHEN c_custkey % 3 <> 0 THEN k % 4 ELSE -1 END::INTEGER AS sent_id, CASE WHEN c_custkey % 3 = 0 THEN 'm' END AS err FROM c WHERE n % 2 = 0 OR k < 5")
def legacy_tasks(spark, sf_dir):
    """Tasks of legacy files (-1: no sentence), up to the first line without a task id."""
    return readers.legacy_ground_truth(_legacy_lines(spark, sf_dir)).fillna(-1, ["sent_id"])


@query("legacy_sentences", f"""{_LEGACY}, x AS (SELECT n, c_name, row_number() OVER (PARTITION BY n ORDER BY k) AS nth FROM c WHERE k <> 3 OR n % 2 = 0)
SELECT c.n::VARCHAR AS case_id, k::INTEGER AS sent_id, 'said ' || c.c_name AS said, 'Text of ' || x.c_name AS sentence FROM c LEFT JOIN x ON x.n = c.n AND x.nth = k WHERE k < 8""")
def legacy_sentences(spark, sf_dir):
    """Sentences of legacy files with their originals, which go by place."""
    return readers.legacy_sentences(_legacy_lines(spark, sf_dir))


@query("snapshots", """SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderkey % 2 = 0)::BIGINT AS first, count(*)::BIGINT AS newest, 3::BIGINT AS n_whole FROM orders GROUP BY o_orderstatus""")
def snapshots(spark, sf_dir):
    """Three snapshots of the orders; the first and the newest are read again."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    path = f"{graph.shared_folder(spark)}/history-{uuid.uuid4().hex}"
    first = history.save(orders.filter("o_orderkey % 2 = 0"), path)
    history.save(orders.filter("o_orderkey % 2 = 1"), path)
    history.save(orders, path)
    count = lambda df, n: df.groupBy("status").agg(F.count(F.lit(1)).alias(n))
    both = count(history.load(spark, path), "newest").join(count(history.load(spark, path, first), "first"), "status", "left")
    return both.select("status", F.coalesce("first", F.lit(0)).alias("first"), "newest", F.lit(len(history.versions(spark, path))).cast("long").alias("n_whole"))
