"""Registered queries of the alignment operators over the driver's tables, each with its SQL where SQL can say it.

documents stand for sentences, benchmark items for labels, events for process logs (a user is a case, event types are
elements), conversations for texts with ordered sentences, and nation -> region for hypernyms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DUMMY_SENTENCE, DUMMY_SIMILARITY, Config
from ..functions import text as T
from ..operators import analysis, assignment, evaluate, features, graph, predictors, similarity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = Config()

#: A few closed-class words with their part of speech, for the stop-word filter over plain tokens.
CLOSED = {"the": "determiner", "a": "determiner", "an": "determiner", "of": "preposition", "in": "preposition", "on": "preposition", "for": "preposition", "by": "preposition", "with": "preposition", "from": "preposition", "at": "preposition", "to": "particle", "and": "conjunction", "or": "conjunction", "but": "conjunction", "can": "modal", "may": "modal", "must": "modal", "should": "modal"}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


# ---------------------------------------------------------------- tokens and TF-IDF

def _tokens(df: DataFrame, key: str, owner: str) -> DataFrame:
    return df.select(F.col(key).alias(owner), F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("lemma"))


def _doc_tokens(spark, sf_dir):
    return _tokens(_read(spark, sf_dir, "documents"), "doc_id", "sent_id")


def _side(spark, sf_dir, table, key, owner):
    """TF-IDF rows of a side; N counts all owners."""
    df = _read(spark, sf_dir, table)
    tf = features.term_frequency(_tokens(df, key, owner), [owner])
    idf = features.inverse_frequency(tf, [], df.agg(F.countDistinct(key).alias("n_owners")))
    return features.tf_idf(tf, idf, [])


def _text(spark, sf_dir):
    return _side(spark, sf_dir, "documents", "doc_id", "sent_id")


def _model(spark, sf_dir):
    return _side(spark, sf_dir, "benchmark", "item_id", "elem_id")


def _forms(rows: DataFrame, owner: str) -> DataFrame:
    return features.feature(rows, [owner], "has-form", [F.col("lemma")], CONFIG, F.col("tfidf"))


def _tok_sql(alias: str, table: str, key: str, owner: str) -> str:
    return f"""{alias}_tok AS (SELECT {owner}, lemma FROM (SELECT {key} AS {owner}, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS lemma FROM {table}) WHERE lemma <> ''),
{alias}_tf AS (SELECT {owner}, lemma, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER (PARTITION BY {owner}) AS tf FROM {alias}_tok GROUP BY {owner}, lemma),
{alias}_idf AS (SELECT lemma, count(*)::BIGINT AS df, ln((SELECT count(DISTINCT {key}) FROM {table}) / count(*)) AS idf FROM {alias}_tf GROUP BY lemma),
{alias}_w AS (SELECT {owner}, lemma, tf, idf, coalesce(tf * idf, 0.001) AS tfidf, 2.0 * coalesce(tf * idf, 0.001) AS w FROM {alias}_tf JOIN {alias}_idf USING (lemma))"""


_T = _tok_sql("t", "documents", "doc_id", "sent_id")
_M = _tok_sql("m", "benchmark", "item_id", "elem_id")
_PAIRS = f"""WITH {_T}, {_M},
tt AS (SELECT sent_id, count(*) AS t_n, sum(w) AS t_w, sqrt(sum(w * w)) AS t_l2 FROM t_w GROUP BY sent_id),
mm AS (SELECT elem_id, count(*) AS m_n, sum(w) AS m_w, sqrt(sum(w * w)) AS m_l2 FROM m_w GROUP BY elem_id),
pairs AS (SELECT t.sent_id, m.elem_id, count(*) AS n_i, sum(CASE WHEN t_n <= m_n THEN t.w ELSE m.w END) AS w_i, sum(least(t.w, m.w)) AS w_min, sum(t.w * m.w) AS dot,
  any_value(t_n) AS t_n, any_value(t_w) AS t_w, any_value(t_l2) AS t_l2, any_value(m_n) AS m_n, any_value(m_w) AS m_w, any_value(m_l2) AS m_l2
  FROM t_w t JOIN m_w m USING (lemma) JOIN tt USING (sent_id) JOIN mm USING (elem_id) GROUP BY t.sent_id, m.elem_id)"""
_SIM_SQL = {
    "cosine": "least(CASE WHEN t_l2 * m_l2 = 0 THEN 0 ELSE dot / (t_l2 * m_l2) END, 1)",
    "jaccard": "n_i / (t_n + m_n - n_i)",
    "fake-jaccard": "n_i / least(t_n, m_n)",
    "raw-weighted-overlapping": "w_i",
    "weighted-fake-jaccard": "CASE WHEN CASE WHEN t_n <= m_n THEN t_w ELSE m_w END = 0 THEN 0 ELSE w_i / CASE WHEN t_n <= m_n THEN t_w ELSE m_w END END",
    "weighted-jaccard": "CASE WHEN t_w + m_w - w_min = 0 THEN 0 ELSE w_i / (t_w + m_w - w_min) END",
}
_SIMS = f"{_PAIRS}, sims AS (SELECT sent_id, elem_id, {_SIM_SQL['weighted-fake-jaccard']} AS sim FROM pairs)"
_ALIGNED = f"{_SIMS}, al AS (SELECT elem_id, sent_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY round(sim, 9) DESC, sent_id) AS r FROM sims) WHERE r = 1)"


def _counted(spark, sf_dir, need: str | None = None):
    """(texts, lengths, few, scale) for similarity.local_*: counts of the few benchmark items' words in each document, and what adds t_w and t_l2 to such rows.

    Of every text the counts of the items' words are written out; these give the words' idf, then the pairs. Where texts need all
    their words (need: of all texts or of short ones, see similarity.NEEDS), the dealt texts are written out too, as they are read for
    the df of all words first.
    """
    docs = _read(spark, sf_dir, "documents")
    n_docs = docs.agg(F.countDistinct("doc_id").alias("n_owners"))
    few = similarity.Few(_forms(_model(spark, sf_dir), "elem_id"), "elem_id")
    texts = docs.select(F.col("doc_id").alias("sent_id"), "text")
    lists = features.term_lists(texts.filter("sent_id is not null"), "sent_id")
    nobody = _tokens(docs.filter("doc_id is null"), "doc_id", "sent_id").distinct()  # counts in df alone, as one text
    common = rare = None
    if need:
        lists = graph.checkpointed(lists)
        df = features.block_frequency(lists).union(nobody.select("lemma", F.lit(1).cast("long"))).groupBy("lemma").agg(F.sum("df").alias("df"))
        common, rare = features.common_terms(graph.checkpointed(features.weighed_frequency(df, [], n_docs)), features.MOST_COMMON)
    counted = graph.checkpointed(features.known_counts(lists, "sent_id", few.vocabulary, common, None if need == "all" else few.longest))
    alone = features.known_counts(nobody.select("sent_id", F.col("lemma").alias("said")), "sent_id", few.vocabulary)
    known = counted.select("terms").union(alone.select("terms")).select(F.explode("terms").alias("term"))
    factor = CONFIG.weights()["has-form"]
    scale = np.zeros(len(few.vocabulary))
    for term, idf in features.inverse_frequency(known, [], n_docs, "term").select("term", "idf").dropna().collect():
        scale[term] = factor * idf
    return counted, (lambda rows: features.with_lengths(rows, "sent_id", rare, factor)) if need else (lambda rows: rows), few, scale


def _doc_lists(texts: DataFrame) -> DataFrame:
    """features.term_lists of documents with an id; only the texts of ids that come several times are dealt and written out."""
    several = graph.checkpointed(texts.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sent_id"))
    n = several.count()
    if n > features.MOST_REPEATED:
        return graph.checkpointed(features.term_lists(texts, "sent_id"))
    alone, dealt = features.placed_lists(texts, several, "sent_id")
    return alone.union(graph.checkpointed(dealt)) if n else alone


def _text_rows(spark, sf_dir):
    """The rows of _text, (sent_id, lemma, tf, idf, tfidf), made where documents lie; only those of rare words and of documents without an id are dealt, by word.

    Documents are read three times instead of being written out: for the df of all words, the rows of common words and those of the others.
    """
    docs = _read(spark, sf_dir, "documents")
    lists = _doc_lists(docs.select(F.col("doc_id").alias("sent_id"), "text").filter("sent_id is not null"))
    nobody = features.term_frequency(_tokens(docs.filter("doc_id is null"), "doc_id", "sent_id"), ["sent_id"])  # one text
    df = features.block_frequency(lists).union(nobody.select("lemma", F.lit(1).cast("long"))).groupBy("lemma").agg(F.sum("df").alias("df"))
    idf = graph.checkpointed(features.weighed_frequency(df, [], docs.agg(F.countDistinct("doc_id").alias("n_owners"))))
    common, _ = features.common_terms(idf, features.MOST_COMMON)
    others = features.term_rows(lists, "sent_id", common, False).union(nobody.select("sent_id", "lemma", "tf"))
    often = features.with_tf_idf(features.term_rows(lists, "sent_id", common, True))
    return often.unionByName(features.tf_idf(others, idf.select("lemma", "idf"), []))


#: The similarity of alignments; digits to which greatest ones are compared.
_ALIGN_BY, _ALIGN_DIGITS = "weighted-fake-jaccard", 9


def _folded(spark, sf_dir):
    """(statistics by element in parts, trivial alignment, statistics of the aligned documents): pairs are folded where documents lie, never written out."""
    counted, lengths, few, scale = _counted(spark, sf_dir, similarity.NEEDS[_ALIGN_BY])
    parts = graph.checkpointed(similarity.local_statistics(lengths(counted), few, scale, _ALIGN_BY, DUMMY_SENTENCE, _ALIGN_DIGITS))
    aligned = graph.checkpointed(predictors.trivial_alignment(parts.filter("sim is not null"), [], digits=_ALIGN_DIGITS, few=True))
    chosen = counted.join(F.broadcast(aligned.select("sent_id").distinct()), "sent_id", "left_semi")
    return parts, aligned, similarity.local_sentence_statistics(lengths(chosen), few, scale, _ALIGN_BY)


def _aligned(spark, sf_dir):
    return _folded(spark, sf_dir)[1]


@query("token_histogram", f"WITH {_T} SELECT lemma, count(*)::BIGINT AS n FROM t_tok GROUP BY lemma")
def token_histogram(spark, sf_dir):
    return _doc_tokens(spark, sf_dir).groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


@query("stopword_filter", f"WITH {_T} SELECT sent_id, count(*)::BIGINT AS n_content FROM t_tok WHERE lemma NOT IN ({', '.join(repr(w) for w in CLOSED)}) GROUP BY sent_id")
def stopword_filter(spark, sf_dir):
    tokens = _doc_tokens(spark, sf_dir)
    pos = F.element_at(F.create_map(*[F.lit(x) for kv in CLOSED.items() for x in kv]), F.col("lemma"))
    return features.content_tokens(tokens.withColumn("pos", pos)).groupBy("sent_id").agg(F.count(F.lit(1)).alias("n_content"))


@query("tf", f"WITH {_T} SELECT sent_id, lemma, n, round(tf, 6) AS tf FROM t_tf")
def tf(spark, sf_dir):
    return features.term_frequency(_doc_tokens(spark, sf_dir), ["sent_id"]).select("sent_id", "lemma", "n", _r("tf").alias("tf"))


@query("idf", f"WITH {_T} SELECT lemma, df, round(idf, 6) AS idf FROM t_idf")
def idf(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    out = features.inverse_frequency(features.term_frequency(_doc_tokens(spark, sf_dir), ["sent_id"]), [], docs.agg(F.countDistinct("doc_id").alias("n_owners")))
    return out.select("lemma", "df", _r("idf").alias("idf"))


@query("tfidf", f"WITH {_T} SELECT sent_id, lemma, round(tfidf, 6) AS tfidf FROM t_w")
def tfidf(spark, sf_dir):
    return _text(spark, sf_dir).select("sent_id", "lemma", _r("tfidf").alias("tfidf"))


@query("text_form_features", f"WITH {_T} SELECT sent_id, 'has-form' AS ftype, lemma AS arg, round(w, 6) AS weight FROM t_w")
def text_form_features(spark, sf_dir):
    return _forms(_text_rows(spark, sf_dir), "sent_id").withColumn("weight", _r("weight"))  # a row for each document and word already


@query("feature_union", f"WITH {_T}, {_M}, a AS (SELECT lemma, max(w) AS w FROM t_w GROUP BY lemma), b AS (SELECT lemma, max(w) AS w FROM m_w GROUP BY lemma) SELECT coalesce(a.lemma, b.lemma) AS arg, round(greatest(coalesce(a.w, b.w), coalesce(b.w, a.w)), 6) AS weight FROM a FULL JOIN b ON a.lemma = b.lemma")
def feature_union(spark, sf_dir):
    a, b = (_forms(f(spark, sf_dir), o).drop(o) for f, o in ((_text, "sent_id"), (_model, "elem_id")))
    return features.union_features(a, b, []).select("arg", _r("weight").alias("weight"))


@query("feature_intersection", f"{_PAIRS} SELECT sent_id, elem_id, n_i::BIGINT AS n_shared, round(w_i, 6) AS weight FROM pairs")
def feature_intersection(spark, sf_dir):
    counted, _, few, scale = _counted(spark, sf_dir)
    return similarity.local_pair_sums(counted, few, scale, ["n_i", "w_i"]).select("sent_id", "elem_id", F.col("n_i").alias("n_shared"), _r("w_i").alias("weight"))


def _similarity_query(name: str) -> None:
    @query("sim_" + name.replace("-", "_"), f"{_PAIRS} SELECT sent_id, elem_id, round({_SIM_SQL[name]}, 6) AS sim FROM pairs")
    def run(spark, sf_dir):
        counted, lengths, few, scale = _counted(spark, sf_dir, similarity.NEEDS.get(name))
        return similarity.local_similarities(lengths(counted), few, scale, name, digits=6)


for _name in similarity.FUNCTIONS:
    _similarity_query(_name)


@query("sim_levenshtein", "SELECT n_name, r_name, levenshtein(n_name, r_name)::BIGINT AS distance FROM nation, region")
def sim_levenshtein(spark, sf_dir):
    pairs = _read(spark, sf_dir, "nation").crossJoin(F.broadcast(_read(spark, sf_dir, "region")))  # 25 by 5 names by definition
    return pairs.select("n_name", "r_name", F.levenshtein("n_name", "r_name").cast("long").alias("distance"))


@query("bag_of_chars_best", f"""WITH p AS (SELECT n_name AS a, r_name AS b FROM nation, region),
x AS (SELECT a, b, c FROM (SELECT DISTINCT a, b, unnest(string_split(a, '')) AS c FROM p) UNION ALL SELECT a, b, c FROM (SELECT DISTINCT a, b, unnest(string_split(b, '')) AS c FROM p)),
d AS (SELECT a, b, sum(abs((len(a) - len(replace(a, c, ''))) - (len(b) - len(replace(b, c, '')))))::BIGINT AS distance FROM x GROUP BY a, b)
SELECT n_name, r_name, distance FROM (SELECT a AS n_name, b AS r_name, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d) WHERE r = 1""")
def bag_of_chars_best(spark, sf_dir):
    pairs = _read(spark, sf_dir, "nation").crossJoin(F.broadcast(_read(spark, sf_dir, "region")))  # 25 by 5 names by definition
    pairs = pairs.select("n_name", "r_name", T.bag_distance(F.col("n_name"), F.col("r_name")).cast("long").alias("distance"))
    return pairs.groupBy("n_name").agg(F.min(F.struct("distance", "r_name")).alias("_b")).select("n_name", "_b.r_name", "_b.distance")


@query("discourse_markers", f"WITH {_T} SELECT DISTINCT sent_id, CASE {' '.join(f'WHEN lemma IN ({", ".join(repr(w) for w in ws)}) THEN {k!r}' for k, ws in features.MARKERS.items())} END AS arg, 10.0::DOUBLE AS weight FROM t_tok WHERE lemma IN ({', '.join(repr(w) for ws in features.MARKERS.values() for w in ws)})")
def discourse_markers(spark, sf_dir):
    return features.marker_features(_doc_tokens(spark, sf_dir), ["sent_id"], CONFIG).select("sent_id", "arg", "weight")


@query("hypernym_features", """WITH p AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
s AS (SELECT child AS node, parent AS ancestor, 0 AS step FROM p UNION ALL SELECT a.child, b.parent, 1 FROM p a JOIN p b ON a.parent = b.child)
SELECT node, ancestor, round(0.3 * pow(0.5, min(step)), 6) AS weight FROM s GROUP BY node, ancestor""")
def hypernym_features(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    nations = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    chain = features.hypernym_chain(customers.union(nations), CONFIG.hypernym_chain_length)
    return chain.select("node", "ancestor", _r(F.lit(0.3) * F.pow(F.lit(CONFIG.hypernym_multiplier), F.col("step"))).alias("weight"))


@query("explain_features", f"WITH {_M} SELECT elem_id, lemma, 'Contains the lemma \"' || lemma || '\"' AS explanation FROM m_w")
def explain_features(spark, sf_dir):
    return _forms(_model(spark, sf_dir), "elem_id").select("elem_id", F.col("arg").alias("lemma"), features.explain(F.col("ftype"), F.col("arg")).alias("explanation"))


# ---------------------------------------------------------------- assignment and predictors

@query("trivial_alignment", f"{_ALIGNED} SELECT elem_id, sent_id, round(sim, 6) AS sim FROM al")
def trivial_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir).select("elem_id", "sent_id", _r("sim").alias("sim"))


@query("best_sentence_per_label", f"{_ALIGNED} SELECT b.item_id, al.sent_id AS doc_id, round(coalesce(sim, 0), 6) AS sim, CASE WHEN sim IS NULL THEN 'missing' ELSE 'aligned' END AS status FROM benchmark b LEFT JOIN al ON b.item_id = al.elem_id")
def best_sentence_per_label(spark, sf_dir):
    items = _read(spark, sf_dir, "benchmark").select("item_id")
    found = _aligned(spark, sf_dir)
    out = items.join(found, items["item_id"] == found["elem_id"], "left")
    return out.select("item_id", F.col("sent_id").alias("doc_id"), _r(F.coalesce("sim", F.lit(0.0))).alias("sim"), F.when(F.col("sim").isNull(), "missing").otherwise("aligned").alias("status"))


@query("unassigned_to_dummy", f"{_ALIGNED} SELECT doc_id AS elem_id, coalesce(min(elem_id), -1)::BIGINT AS assigned FROM documents LEFT JOIN al ON doc_id = sent_id GROUP BY doc_id")
def unassigned_to_dummy(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.lit(0).alias("case_id"), F.col("doc_id").alias("elem_id"))
    taken = _aligned(spark, sf_dir).groupBy("sent_id").agg(F.min("elem_id").alias("item"))
    given = taken.select(F.lit(0).alias("case_id"), F.col("sent_id").alias("elem_id"), F.col("item").alias("sent_id"))
    return assignment.unassigned(docs, given, "case_id", DUMMY_SENTENCE).select("elem_id", F.col("sent_id").alias("assigned"))


def _stats(spark, sf_dir):
    parts, aligned, by_sent = _folded(spark, sf_dir)
    sizes = _read(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("n_sents")).crossJoin(_read(spark, sf_dir, "benchmark").agg(F.countDistinct("item_id").alias("n_elems")))  # one row by one
    return predictors.folded(parts, by_sent, aligned, sizes)


_STATS = f"""{_ALIGNED}, el AS (SELECT elem_id, max(sim) AS t_max, sum(sim) AS t_sum, sqrt(sum(sim * sim)) AS t_l2, sum(CASE WHEN sim > 0 THEN sim * ln(sim) END) AS t_plogp, sum(CASE WHEN sim > 0 THEN sim END) AS t_pos FROM sims GROUP BY elem_id),
se AS (SELECT sent_id, max(sim) AS s_max, sum(sim) AS s_sum FROM sims GROUP BY sent_id),
st AS (SELECT al.*, el.* EXCLUDE (elem_id), se.* EXCLUDE (sent_id), (SELECT max(sim) FROM sims) AS c_max, (SELECT avg(sim) FROM al) AS a_avg,
  (SELECT count(DISTINCT doc_id) FROM documents) AS n_sents, (SELECT count(DISTINCT item_id) FROM benchmark) AS n_elems FROM al JOIN el USING (elem_id) JOIN se USING (sent_id)),
pr AS (SELECT *, sim AS p_sim, sim / nullif(c_max, 0) AS p_rel, sim / nullif(t_max, 0) AS p_rel_t, sim / nullif(t_sum / n_sents, 0) AS p_avg_t, sim / nullif(t_sum, 0) AS p_avgn_t, sim / nullif(s_max, 0) AS p_rel_s,
  sim / nullif(s_sum, 0) AS p_avgn_s, sim / nullif(s_sum / n_elems, 0) AS p_avg_s, sim - t_sum / n_sents AS s_diff, sim - a_avg AS a_diff, -(t_plogp - t_pos * ln(t_l2)) / t_l2 AS entropy_s FROM st)"""
_PREDICTOR_SQL = {
    "p-sim": "p_sim", "p-rel": "coalesce(p_rel, 0)", "p-rel-T": "coalesce(p_rel_t, 0)", "p-avg-T": "coalesce(p_avg_t, 0)", "p-avgN-T": "coalesce(p_avgn_t, 0)", "p-rel-S": "coalesce(p_rel_s, 0)",
    "p-avgN-S": "coalesce(p_avgn_s, 0)", "p-avg-S": "coalesce(p_avg_s, 0)", "S-diff": "s_diff", "A-diff": "a_diff", "entropy-S": "entropy_s",
    "entropy-ensemble": "2 / (1 / nullif(entropy_s, 0) + 1 / nullif(p_rel_s, 0))", "students-missing": "2 / (1 / nullif(p_rel_s, 0) + 1 / nullif(p_sim, 0))",
}


def _predictor_query(name: str) -> None:
    @query("predictor_" + name.replace("-", "_").lower(), f"{_STATS} SELECT elem_id, round({_PREDICTOR_SQL[name]}, 6) AS value FROM pr")
    def run(spark, sf_dir):
        return _stats(spark, sf_dir).select("elem_id", _r(predictors.predictor(name)).alias("value"))


for _name in predictors.BASIC:
    _predictor_query(_name)

_ENSEMBLE_SQL = " UNION ALL ".join(f"SELECT elem_id, '{e}' AS predictor, round(({' + '.join(_PREDICTOR_SQL[p] for p in e.split('+'))}) / 3, 6) AS value FROM pr" for e in predictors.ENSEMBLES)


@query("predictor_ensembles", f"{_STATS} {_ENSEMBLE_SQL}")
def predictor_ensembles(spark, sf_dir):
    values = F.explode(F.array(*[F.struct(F.lit(e).alias("predictor"), _r(predictors.predictor(e)).alias("value")) for e in predictors.ENSEMBLES])).alias("_v")
    return _stats(spark, sf_dir).select("elem_id", values).select("elem_id", "_v.predictor", "_v.value")


_SWEPT, _THRESHOLDS = ["p-sim", "p-rel", "p-rel-T", "p-rel-S"], [0.1, 0.2, 0.5]


@query("cutoff_sweep", f"{_STATS} " + " UNION ALL ".join(f"SELECT elem_id, '{p}' AS predictor, {t}::DOUBLE AS threshold, {_PREDICTOR_SQL[p]} < {t} AS missing FROM pr" for p in _SWEPT for t in _THRESHOLDS))
def cutoff_sweep(spark, sf_dir):
    return predictors.sweep(_stats(spark, sf_dir), _SWEPT, _THRESHOLDS, ["elem_id"])


@query("missing_elements", f"{_STATS} SELECT elem_id, CASE WHEN coalesce(p_rel_s, 0) >= 0.2 THEN sent_id END AS sent_id, coalesce(p_rel_s, 0) < 0.2 AS missing FROM pr")
def missing_elements(spark, sf_dir):
    return predictors.cutoff(_stats(spark, sf_dir), CONFIG.missing_predictor_type, CONFIG.threshold_missing).select("elem_id", "sent_id", "missing")


@query("total_score", f"{_ALIGNED} SELECT round(2 * sum(sim) / ((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)), 9) AS total_score FROM al")
def total_score(spark, sf_dir):
    one = F.lit(0).alias("case_id")
    sizes = [_read(spark, sf_dir, t).groupBy(one).agg(F.count(F.lit(1)).alias("n")) for t in ("documents", "benchmark")]
    scored = assignment.total_score(_aligned(spark, sf_dir).withColumn("case_id", F.lit(0)), *sizes, "case_id")
    return scored.select(_r("total_score", 9).alias("total_score"))


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("words"))


def _conversation(spark, sf_dir):
    """Assistant turns as elements, user turns as sentences, similarity by shared over all words; a conversation is a case."""
    turns = _turns(spark, sf_dir)
    s = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("sent_id"), F.col("words").alias("_s"))
    e = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("elem_id"), F.col("words").alias("_e"))
    common = F.size(F.array_intersect("_s", "_e"))
    return s.join(e, "conv_id").select("conv_id", "sent_id", "elem_id", T.ratio(common, F.size("_s") + F.size("_e") - common).alias("sim"))


_CONV = """WITH w AS (SELECT conv_id, turn, role, list_distinct(list(lemma) FILTER (WHERE lemma <> '')) AS words FROM (SELECT conv_id, turn, role, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS lemma FROM conversations) GROUP BY conv_id, turn, role),
cs AS (SELECT s.conv_id, s.turn AS sent_id, e.turn AS elem_id, len(list_intersect(s.words, e.words)) AS k, len(s.words) AS a, len(e.words) AS b FROM w s JOIN w e ON s.conv_id = e.conv_id AND s.role = 'user' AND e.role = 'assistant'),
sims AS (SELECT conv_id, sent_id, elem_id, CASE WHEN a + b - k = 0 THEN 0 ELSE k / (a + b - k) END::DOUBLE AS sim FROM cs)"""


@query("conversation_similarity", f"{_CONV} SELECT conv_id, sent_id, elem_id, round(sim, 6) AS sim FROM sims")
def conversation_similarity(spark, sf_dir):
    return _conversation(spark, sf_dir).withColumn("sim", _r("sim"))


def _before(sims: DataFrame) -> DataFrame:
    """Consecutive elements of a conversation."""
    elems = sims.select("conv_id", "elem_id").distinct()
    w = Window.partitionBy("conv_id").orderBy("elem_id")
    return elems.withColumn("dst", F.lead("elem_id").over(w)).filter("dst is not null").select("conv_id", F.col("elem_id").alias("src"), "dst")


def _solved(spark, sf_dir):
    sims = graph.checkpointed(_conversation(spark, sf_dir))
    elements = sims.select("conv_id", "elem_id", F.lit(False).alias("is_gateway")).distinct()
    return sims, graph.checkpointed(assignment.constrained_alignment(sims, elements, _before(sims), "conv_id"))


# the optimum over a total order by enumerating monotone choices; conversations have few turns
_MONO = f"""{_CONV.replace('WITH w', 'WITH RECURSIVE w', 1)},
el AS (SELECT conv_id, elem_id, row_number() OVER (PARTITION BY conv_id ORDER BY elem_id) AS i FROM (SELECT DISTINCT conv_id, elem_id FROM sims)),
g AS (SELECT s.conv_id, el.i, s.sent_id, s.sim FROM sims s JOIN el ON s.conv_id = el.conv_id AND s.elem_id = el.elem_id),
r(conv_id, i, sent_id, total) AS (SELECT conv_id, i, sent_id, sim FROM g WHERE i = 1
  UNION ALL SELECT g.conv_id, g.i, g.sent_id, r.total + g.sim FROM r JOIN g ON g.conv_id = r.conv_id AND g.i = r.i + 1 AND g.sent_id >= r.sent_id),
best AS (SELECT r.conv_id, max(total) AS best FROM r JOIN (SELECT conv_id, max(i) AS n FROM el GROUP BY conv_id) m ON r.conv_id = m.conv_id AND r.i = m.n GROUP BY r.conv_id)"""


# the chosen sentences: of the optima, the one with the smallest sentences
_CHOSEN = f"""{_CONV.replace('WITH w', 'WITH RECURSIVE w', 1)},
el AS (SELECT conv_id, elem_id, row_number() OVER (PARTITION BY conv_id ORDER BY elem_id) AS i FROM (SELECT DISTINCT conv_id, elem_id FROM sims)),
g AS (SELECT s.conv_id, el.i, s.elem_id, s.sent_id, s.sim FROM sims s JOIN el ON s.conv_id = el.conv_id AND s.elem_id = el.elem_id),
r(conv_id, i, sent_id, total, path) AS (SELECT conv_id, i, sent_id, sim, [sent_id] FROM g WHERE i = 1
  UNION ALL SELECT g.conv_id, g.i, g.sent_id, r.total + g.sim, list_append(r.path, g.sent_id) FROM r JOIN g ON g.conv_id = r.conv_id AND g.i = r.i + 1 AND g.sent_id >= r.sent_id),
ends AS (SELECT r.conv_id, path, row_number() OVER (PARTITION BY r.conv_id ORDER BY round(total, 9) DESC, path) AS k FROM r JOIN (SELECT conv_id, max(i) AS n FROM el GROUP BY conv_id) m ON r.conv_id = m.conv_id AND r.i = m.n),
co AS (SELECT g.conv_id, g.elem_id, g.sent_id, g.sim FROM ends e JOIN g ON g.conv_id = e.conv_id AND g.sent_id = e.path[g.i] WHERE k = 1),
tr AS (SELECT conv_id, elem_id, sent_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, elem_id ORDER BY sim DESC, sent_id) AS k FROM sims) WHERE k = 1),
mc AS (SELECT co.conv_id, max(tr.sim - co.sim) AS max_constrained FROM co JOIN tr ON co.conv_id = tr.conv_id AND co.elem_id = tr.elem_id GROUP BY co.conv_id)"""


@query("constrained_alignment", f"{_CHOSEN} SELECT conv_id, elem_id, sent_id, round(sim, 6) AS sim FROM co")
def constrained_alignment(spark, sf_dir):
    return _solved(spark, sf_dir)[1].withColumn("sim", _r("sim"))


# elements in order; every third is a gateway: it takes the dummy or a sentence of its own that is not before the earlier ones'
_GATES_SQL = f"""{_CONV.replace('WITH w', 'WITH RECURSIVE w', 1)},
el AS (SELECT conv_id, elem_id, row_number() OVER (PARTITION BY conv_id ORDER BY elem_id) AS i FROM (SELECT DISTINCT conv_id, elem_id FROM sims)),
g AS (SELECT s.conv_id, el.i, s.sent_id, s.sim, el.i % 3 = 2 AS gate FROM sims s JOIN el ON s.conv_id = el.conv_id AND s.elem_id = el.elem_id UNION ALL SELECT conv_id, i, -1, {DUMMY_SIMILARITY}, true FROM el WHERE i % 3 = 2),
r(conv_id, i, last, taken, total) AS (SELECT conv_id, 0::BIGINT, -1::BIGINT, []::BIGINT[], 0::DOUBLE FROM el WHERE i = 1
  UNION ALL SELECT g.conv_id, g.i, CASE WHEN gate THEN r.last ELSE g.sent_id END, CASE WHEN gate AND g.sent_id >= 0 THEN list_append(r.taken, g.sent_id) ELSE r.taken END, r.total + g.sim
  FROM r JOIN g ON g.conv_id = r.conv_id AND g.i = r.i + 1 AND (g.sent_id >= r.last OR gate AND g.sent_id = -1) AND NOT (gate AND list_contains(r.taken, g.sent_id)))
SELECT r.conv_id, round(max(total), 6) AS best FROM r JOIN (SELECT conv_id, max(i) AS n FROM el GROUP BY conv_id) m ON r.conv_id = m.conv_id AND r.i = m.n GROUP BY r.conv_id"""


@query("gateway_alignment", _GATES_SQL)
def gateway_alignment(spark, sf_dir):
    """The optimum with gateways and the dummy sentence, per conversation; all pairs of elements are in order."""
    sims = graph.checkpointed(_conversation(spark, sf_dir))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("elem_id"))
    elements = sims.select("conv_id", "elem_id").distinct().withColumn("is_gateway", nth % 3 == 2)
    ends = elements.select("conv_id", "elem_id")
    before = ends.withColumnRenamed("elem_id", "src").join(ends.withColumnRenamed("elem_id", "dst"), "conv_id").filter("src < dst")
    found = assignment.constrained_alignment(sims, elements, before, "conv_id", anchors=True)
    return found.groupBy("conv_id").agg(_r(F.sum("sim")).alias("best"))


@query("constrained_objective", f"{_MONO} SELECT conv_id, round(best, 6) AS best FROM best")
def constrained_objective(spark, sf_dir):
    """The solver's total per conversation."""
    return _solved(spark, sf_dir)[1].groupBy("conv_id").agg(_r(F.sum("sim")).alias("best"))


@query("text_order_monotone_alignment", f"{_MONO} SELECT conv_id, round(best, 6) AS best FROM best")
def text_order_monotone_alignment(spark, sf_dir):
    out = assignment.monotone_total_order(_conversation(spark, sf_dir), "conv_id", "elem_id", "sent_id")
    return out.select("conv_id", _r("best").alias("best"))


@query("constrained_against_trivial", f"{_MONO}, t AS (SELECT conv_id, sum(m) AS trivial FROM (SELECT conv_id, elem_id, max(sim) AS m FROM sims GROUP BY conv_id, elem_id) GROUP BY conv_id) SELECT best.conv_id, round(trivial - best, 6) + 0.0 AS loss FROM best JOIN t ON best.conv_id = t.conv_id")
def constrained_against_trivial(spark, sf_dir):
    sims, solved = _solved(spark, sf_dir)
    free = predictors.trivial_alignment(sims, ["conv_id"]).groupBy("conv_id").agg(F.sum("sim").alias("_t"))
    return free.join(solved.groupBy("conv_id").agg(F.sum("sim").alias("_c")), "conv_id").select("conv_id", (_r(F.col("_t") - F.col("_c")) + 0.0).alias("loss"))


@query("max_constrained", f"{_CHOSEN} SELECT conv_id, round(max_constrained, 6) AS max_constrained FROM mc")
def max_constrained(spark, sf_dir):
    sims, solved = _solved(spark, sf_dir)
    return assignment.max_constrained(predictors.trivial_alignment(sims, ["conv_id"]), solved, "conv_id").withColumn("max_constrained", _r("max_constrained"))


@query("wrong_order_correction", f"{_CHOSEN} SELECT conv_id, elem_id, sent_id, round(sim, 6) AS sim FROM tr WHERE conv_id IN (SELECT conv_id FROM mc WHERE max_constrained > 0.05) UNION ALL SELECT conv_id, elem_id, sent_id, round(sim, 6) FROM co WHERE conv_id NOT IN (SELECT conv_id FROM mc WHERE max_constrained > 0.05)")
def wrong_order_correction(spark, sf_dir):
    sims, solved = _solved(spark, sf_dir)
    free = predictors.trivial_alignment(sims, ["conv_id"])
    loss = assignment.max_constrained(free, solved, "conv_id")
    return assignment.correct_order(free, solved, loss, 0.05, "conv_id").withColumn("sim", _r("sim"))


# ---------------------------------------------------------------- order and graphs

@query("sentence_order", "SELECT a.conv_id, a.turn AS x, b.turn AS y, CASE WHEN a.turn * b.turn < 0 THEN '||' WHEN a.turn < b.turn THEN '->' WHEN a.turn > b.turn THEN '<-' ELSE '!=' END AS rel FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id")
def sentence_order(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    pairs = c.select("conv_id", F.col("turn").alias("x")).join(c.select("conv_id", F.col("turn").alias("y")), "conv_id")
    return pairs.select("conv_id", "x", "y", graph.sentence_order(F.col("x"), F.col("y")).alias("rel"))


def _follows(spark, sf_dir):
    """Directly-follows edges of each user's events, with the user's first event type as start."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("src"))
    e = e.withColumn("dst", F.lead("src").over(w)).withColumn("start", F.first("src").over(w))
    return e.filter("dst is not null").groupBy("user_id", "start", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


_FOLLOWS = """ev AS (SELECT user_id, event_type AS src, lead(event_type) OVER w AS dst, first_value(event_type) OVER w AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
fo AS (SELECT user_id, start, src, dst, count(*)::BIGINT AS n FROM ev WHERE dst IS NOT NULL GROUP BY user_id, start, src, dst)"""
_FIRST = """fi AS (SELECT user_id, event_type, min(event_id) AS at FROM events GROUP BY user_id, event_type),
da AS (SELECT fo.user_id, fo.start, fo.src, fo.dst FROM fo JOIN fi a ON fo.user_id = a.user_id AND fo.src = a.event_type JOIN fi b ON fo.user_id = b.user_id AND fo.dst = b.event_type WHERE a.at < b.at)"""


def _forward(spark, sf_dir):
    """Those whose source was first seen earlier: an acyclic graph per user."""
    first = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("_at"))
    out = _follows(spark, sf_dir)
    for end in ("src", "dst"):
        out = out.join(first.withColumnsRenamed({"event_type": end, "_at": f"_{end}"}), ["user_id", end])
    return out.filter("_src < _dst").select("user_id", "start", "src", "dst")


@query("process_graph", f"WITH {_FOLLOWS} SELECT user_id, src, dst, n FROM fo")
def process_graph(spark, sf_dir):
    return _follows(spark, sf_dir).select("user_id", "src", "dst", "n")


@query("graph_degrees", f"WITH {_FOLLOWS} SELECT user_id, node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT user_id, src AS node, 0 AS i, 1 AS o FROM fo UNION ALL SELECT user_id, dst, 1, 0 FROM fo) GROUP BY user_id, node")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_follows(spark, sf_dir), ["user_id"])


@query("alignable_elements", f"WITH {_FOLLOWS}, {_FIRST}, deg AS (SELECT user_id, node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT user_id, src AS node, 0 AS i, 1 AS o FROM da UNION ALL SELECT user_id, dst, 1, 0 FROM da) GROUP BY user_id, node) SELECT user_id, node, CASE WHEN node IN ('click', 'view') THEN 'Task' WHEN node IN ('purchase', 'signup') THEN 'Event' ELSE 'Gateway' END AS elem_type FROM deg WHERE node <> 'error' OR (n_in = 1 AND n_out >= 1)")
def alignable_elements(spark, sf_dir):
    """Tasks, named events, and gateways with one way in and at least one out; errors stand for gateways."""
    from . import align

    kind = F.when(F.col("elem_id").isin("click", "view"), "Task").when(F.col("elem_id").isin("purchase", "signup"), "Event").otherwise("Gateway")
    edges = graph.checkpointed(_forward(spark, sf_dir).select(F.col("user_id").alias("case_id"), "src", "dst"))
    nodes = edges.select("case_id", F.explode(F.array("src", "dst")).alias("elem_id")).distinct()
    elements = nodes.select("case_id", F.lit("p").alias("process_id"), "elem_id", kind.alias("elem_type"), F.lit(None).cast("string").alias("tag"), F.col("elem_id").alias("name"))
    found = align._alignable({"elements": elements, "edges": edges}, CONFIG.but(enable_anchors=True))
    return found.select(F.col("case_id").alias("user_id"), F.col("elem_id").alias("node"), "elem_type")


_REACH = f"WITH RECURSIVE {_FOLLOWS}, {_FIRST}, r(user_id, src, dst) AS (SELECT user_id, src, dst FROM da UNION SELECT r.user_id, r.src, da.dst FROM r JOIN da ON r.user_id = da.user_id AND r.dst = da.src)"


@query("reachability", f"{_REACH} SELECT user_id, src, dst FROM r")
def reachability(spark, sf_dir):
    return graph.closure(_forward(spark, sf_dir), ["user_id"])


@query("behavioural_profile", f"{_REACH}, no AS (SELECT DISTINCT user_id, node FROM (SELECT user_id, src AS node FROM da UNION ALL SELECT user_id, dst FROM da)) SELECT a.user_id, a.node AS x, b.node AS y, CASE WHEN a.node = b.node THEN '!=' WHEN f.src IS NOT NULL THEN '->' WHEN g.src IS NOT NULL THEN '<-' ELSE '||' END AS rel FROM no a JOIN no b ON a.user_id = b.user_id LEFT JOIN r f ON f.user_id = a.user_id AND f.src = a.node AND f.dst = b.node LEFT JOIN r g ON g.user_id = a.user_id AND g.src = b.node AND g.dst = a.node")
def behavioural_profile(spark, sf_dir):
    edges = graph.checkpointed(_forward(spark, sf_dir))
    nodes = edges.select("user_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.relations(nodes, graph.closure(edges, ["user_id"]), ["user_id"])


@query("topological_levels", f"WITH RECURSIVE {_FOLLOWS}, {_FIRST}, no AS (SELECT user_id, src AS node FROM da UNION SELECT user_id, dst FROM da), l(user_id, node, level) AS (SELECT user_id, node, 0 FROM no WHERE NOT EXISTS (SELECT 1 FROM da WHERE da.user_id = no.user_id AND da.dst = no.node) UNION SELECT l.user_id, da.dst, l.level + 1 FROM l JOIN da ON l.user_id = da.user_id AND l.node = da.src) SELECT user_id, node, max(level)::INTEGER AS level FROM l GROUP BY user_id, node")
def topological_levels(spark, sf_dir):
    return graph.levels(_forward(spark, sf_dir), ["user_id"])


# b dominates x if x is out of reach once b is taken out
_DOM = f"""WITH RECURSIVE {_FOLLOWS}, no AS (SELECT DISTINCT user_id, start, node FROM (SELECT user_id, start, src AS node FROM fo UNION ALL SELECT user_id, start, dst FROM fo)),
av(user_id, b, x) AS (SELECT user_id, node, start FROM no WHERE node <> start UNION SELECT av.user_id, av.b, fo.dst FROM av JOIN fo ON fo.user_id = av.user_id AND fo.src = av.x AND fo.dst <> av.b),
dm AS (SELECT x.user_id, x.node, b.node AS dom FROM no x JOIN no b ON x.user_id = b.user_id WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.user_id = x.user_id AND av.b = b.node AND av.x = x.node))"""


@query("dominators", f"{_DOM} SELECT user_id, node, dom FROM dm")
def dominators(spark, sf_dir):
    return graph.dominators(_follows(spark, sf_dir), "user_id")


@query("back_edges", f"{_DOM} SELECT fo.user_id, fo.src, fo.dst FROM fo JOIN dm ON dm.user_id = fo.user_id AND dm.node = fo.src AND dm.dom = fo.dst")
def back_edges(spark, sf_dir):
    return graph.back_edges(_follows(spark, sf_dir), "user_id").select("user_id", "src", "dst")


@query("acyclic_graph", f"{_DOM} SELECT fo.user_id, fo.src, fo.dst FROM fo WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.user_id = fo.user_id AND dm.node = fo.src AND dm.dom = fo.dst)")
def acyclic_graph(spark, sf_dir):
    return graph.acyclic(_follows(spark, sf_dir), "user_id").select("user_id", "src", "dst")


@query("graph_reduction", f"""WITH RECURSIVE {_FOLLOWS}, {_FIRST}, p(user_id, src, dst) AS (SELECT user_id, src, dst FROM da WHERE src <> 'error' UNION SELECT p.user_id, p.src, da.dst FROM p JOIN da ON da.user_id = p.user_id AND da.src = p.dst AND p.dst = 'error') SELECT user_id, src, dst FROM p WHERE dst <> 'error'""")
def graph_reduction(spark, sf_dir):
    edges = graph.checkpointed(_forward(spark, sf_dir))
    gone = edges.select("user_id", F.lit("error").alias("node")).distinct()
    return graph.bypass(edges, gone, ["user_id"])


def _flows(spark, sf_dir):
    """Each purchase of a user with the next event as a message flow, in event order; a user is a case."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 40).alias("src"), "event_type")
    e = e.withColumn("dst", F.lead("src").over(w) + 100)
    return e.filter("event_type = 'purchase' and dst is not null").select("user_id", F.col("event_id").alias("seq"), "src", "dst")


@query("message_flow_filter", """WITH e AS (SELECT user_id, event_id AS seq, event_id % 40 AS src, lead(event_id % 40) OVER (PARTITION BY user_id ORDER BY event_id) + 100 AS dst, event_type FROM events),
f AS (SELECT user_id, seq, src, dst FROM e WHERE event_type = 'purchase' AND dst IS NOT NULL)
SELECT user_id, seq, src, dst FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.user_id = a.user_id AND b.seq < a.seq AND (b.src IN (a.src, a.dst) OR b.dst IN (a.src, a.dst)))""")
def message_flow_filter(spark, sf_dir):
    return graph.usable_message_flows(_flows(spark, sf_dir), ["user_id"])


@query("merged_process_order", f"""WITH RECURSIVE {_FOLLOWS}, {_FIRST}, ms AS (SELECT user_id // 2 AS case_id, 2 * (user_id // 2) || ':purchase' AS src, (2 * (user_id // 2) + 1) || ':signup' AS dst FROM fi WHERE event_type = 'purchase' AND user_id % 2 = 0),
e AS (SELECT user_id // 2 AS case_id, user_id || ':' || src AS src, user_id || ':' || dst AS dst FROM da UNION SELECT * FROM ms),
r(case_id, src, dst) AS (SELECT * FROM e UNION SELECT r.case_id, r.src, e.dst FROM r JOIN e ON e.case_id = r.case_id AND e.src = r.dst) SELECT case_id, src, dst FROM r""")
def merged_process_order(spark, sf_dir):
    """Two users' graphs are two processes of one case; the first one's purchase sends a message to the second one's signup."""
    edges, case = _forward(spark, sf_dir), F.floor(F.col("user_id") / 2).cast("long").alias("case_id")
    name = lambda end: F.concat_ws(":", F.col("user_id"), F.col(end)).alias(end)
    senders = _read(spark, sf_dir, "events").filter("event_type = 'purchase' and user_id % 2 = 0").select("user_id").distinct()
    flows = senders.select(case, F.concat_ws(":", "user_id", F.lit("purchase")).alias("src"), F.concat_ws(":", F.col("user_id") + 1, F.lit("signup")).alias("dst"))
    return graph.merge_message_flows(edges.select(case, name("src"), name("dst")), flows, ["case_id"])


@query("start_end_validation", f"WITH {_FOLLOWS}, {_FIRST}, el AS (SELECT DISTINCT user_id, event_type AS node FROM events), s AS (SELECT DISTINCT user_id, start FROM fo) SELECT el.user_id, count(*) FILTER (WHERE el.node = s.start)::BIGINT AS n_starts, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM da WHERE da.user_id = el.user_id AND da.src = el.node))::BIGINT AS n_ends, count(*) FILTER (WHERE el.node = s.start) = 1 AND count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM da WHERE da.user_id = el.user_id AND da.src = el.node)) >= 1 AS valid FROM el LEFT JOIN s ON el.user_id = s.user_id GROUP BY el.user_id")
def start_end_validation(spark, sf_dir):
    edges = _forward(spark, sf_dir)
    starts = _follows(spark, sf_dir).select("user_id", "start").distinct()
    elements = _read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("elem_id")).distinct().join(starts, "user_id", "left")
    tagged = elements.withColumn("tag", F.when(F.col("elem_id") == F.col("start"), "startEvent").otherwise("task"))
    return graph.starts_and_ends(tagged, edges, ["user_id"])


# b post-dominates x if no end can be reached from x once b is taken out
@query("sese_pairs", f"""WITH RECURSIVE {_FOLLOWS}, {_FIRST}, no AS (SELECT user_id, src AS node FROM da UNION SELECT user_id, dst FROM da),
en AS (SELECT user_id, node FROM no WHERE NOT EXISTS (SELECT 1 FROM da WHERE da.user_id = no.user_id AND da.src = no.node)),
av(user_id, b, x) AS (SELECT no.user_id, no.node, en.node FROM no JOIN en ON en.user_id = no.user_id AND en.node <> no.node UNION SELECT av.user_id, av.b, da.src FROM av JOIN da ON da.user_id = av.user_id AND da.dst = av.x AND da.src <> av.b),
pd AS (SELECT x.user_id, x.node, b.node AS dom FROM no x JOIN no b ON x.user_id = b.user_id WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.user_id = x.user_id AND av.b = b.node AND av.x = x.node)),
dp AS (SELECT user_id, node, count(*) AS d FROM pd GROUP BY user_id, node),
op AS (SELECT user_id, src AS node FROM da GROUP BY user_id, src HAVING count(*) > 1), cl AS (SELECT user_id, dst AS node FROM da GROUP BY user_id, dst HAVING count(*) > 1)
SELECT user_id, open, close FROM (SELECT pd.user_id, pd.node AS open, pd.dom AS close, row_number() OVER (PARTITION BY pd.user_id, pd.node ORDER BY d DESC, pd.dom) AS k FROM pd JOIN op ON op.user_id = pd.user_id AND op.node = pd.node JOIN cl ON cl.user_id = pd.user_id AND cl.node = pd.dom JOIN dp ON dp.user_id = pd.user_id AND dp.node = pd.dom WHERE pd.node <> pd.dom) WHERE k = 1""")
def sese_pairs(spark, sf_dir):
    edges = graph.checkpointed(_forward(spark, sf_dir))
    gates = edges.select("user_id", F.explode(F.array("src", "dst")).alias("elem_id")).distinct()
    return graph.sese_pairs(edges, gates, "user_id")


# ---------------------------------------------------------------- evaluation

_PRONOUNS = ("it", "he", "she", "they", "this", "that", "es", "er", "sie", "il", "elle", "el", "ella")


@query("anaphora_resolution", f"""WITH m AS (SELECT conv_id, role, turn, text, lower(regexp_extract(coalesce(text, ''), '^[^\\p{{L}}]*(\\p{{L}}*)', 1)) IN ({', '.join(map(repr, _PRONOUNS))}) AS pronoun, row_number() OVER w AS r, first_value(text) OVER w AS head FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn))
SELECT conv_id, turn, md5(CASE WHEN r > 1 AND pronoun THEN head ELSE text END) AS resolved_md5 FROM m""")
def anaphora_resolution(spark, sf_dir):
    """Turns are tokens and a role's turns an entity's mentions: later ones that open with a pronoun take the first one's text, and keep their place."""
    first = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\p{L}]*(\p{L}*)", 1))
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("sent_id"), F.lit(1).alias("tok_id"), "role", F.col("text").alias("form"), first.alias("lemma"))
    none = F.lit(None).cast("string")
    tokens = turns.drop("role").select("*", F.when(F.col("lemma").isin(*_PRONOUNS), "pronoun").alias("pos"), none.alias("vform"), none.alias("wn"))
    mentions = turns.select("case_id", F.col("role").alias("entity_id"), F.col("sent_id").alias("seq"), "sent_id", "tok_id")
    return analysis.resolve_anaphoras(tokens, mentions).select(F.col("case_id").alias("conv_id"), F.col("sent_id").alias("turn"), F.md5("form").alias("resolved_md5"))


def _answers(spark, sf_dir):
    """labels stand for two annotators of the same elements: quality decides the sentence, toxic the error."""
    labels = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    base = labels.select(F.col("source").alias("case_id"), F.col("doc_id").alias("elem_id"), "quality", "toxic", F.col("lang").alias("class"))
    truth = base.select("case_id", "elem_id", F.when(F.col("quality") == 1, F.col("elem_id") % 7).alias("sent_id"), F.when(F.col("quality") == 0, "m").alias("err"))
    guess = base.select("case_id", "elem_id", F.when(F.col("toxic") == 0, F.col("elem_id") % 7).alias("sent_id"), F.when(F.col("toxic") == 1, "m").alias("err"))
    return guess, truth, base


_COMPARED = "WITH b AS (SELECT source AS case_id, d.doc_id AS elem_id, lang AS class, CASE WHEN quality = 1 THEN (d.doc_id % 7)::VARCHAR ELSE 'm' END AS t, CASE WHEN toxic = 0 THEN (d.doc_id % 7)::VARCHAR ELSE 'm' END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT case_id, elem_id, class, p = t AS correct FROM b)"


@query("gt_compare", f"{_COMPARED} SELECT case_id, elem_id, correct, false AS one_sided FROM c")
def gt_compare(spark, sf_dir):
    guess, truth, _ = _answers(spark, sf_dir)
    return evaluate.compare(guess, truth)


_ACC = f"{_COMPARED}, a AS (SELECT case_id, coalesce(class, 'all') AS class, count(*) FILTER (WHERE correct)::BIGINT AS n_correct, count(*)::BIGINT AS n_total FROM c GROUP BY GROUPING SETS ((case_id), (case_id, class)))"


@query("accuracy_by_class", f"{_ACC} SELECT case_id, class, n_correct, n_total, round(n_correct / n_total, 6) AS accuracy FROM a")
def accuracy_by_class(spark, sf_dir):
    guess, truth, base = _answers(spark, sf_dir)
    return evaluate.accuracy_by_class(evaluate.compare(guess, truth), base).withColumn("accuracy", _r("accuracy"))


@query("accuracy_summary", f"{_ACC} SELECT class, round(avg(n_correct / n_total), 6) AS mean_case_accuracy, round(sum(n_correct) / sum(n_total), 6) AS pooled_accuracy, round(median(n_correct / n_total), 6) AS median_accuracy FROM a GROUP BY class")
def accuracy_summary(spark, sf_dir):
    guess, truth, base = _answers(spark, sf_dir)
    out = evaluate.accuracy_summary(evaluate.accuracy_by_class(evaluate.compare(guess, truth), base), ["class"])
    return out.select("class", *[_r(c).alias(c) for c in ("mean_case_accuracy", "pooled_accuracy", "median_accuracy")])


@query("gt_structure", f"{_STATS} SELECT elem_id, CASE WHEN coalesce(p_rel_s, 0) >= 0.2 THEN sent_id - 1 END AS sent_id, CASE WHEN coalesce(p_rel_s, 0) < 0.2 THEN 'm' END AS err FROM pr")
def gt_structure(spark, sf_dir):
    out = predictors.cutoff(_stats(spark, sf_dir), CONFIG.missing_predictor_type, CONFIG.threshold_missing).withColumn("case_id", F.lit(0))
    return evaluate.gt_structure(out).drop("case_id")


@query("label_cleaning", "SELECT p_partkey, regexp_replace(replace(p_name, chr(10), ' '), '^[\\s.;]+|[\\s.;]+$', '', 'g') AS label FROM part")
def label_cleaning(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.clean_label(F.col("p_name")).alias("label"))


@query("l2_normalised_similarity", f"{_SIMS} SELECT sent_id, elem_id, round(sim / nullif(sqrt(sum(sim * sim) OVER (PARTITION BY elem_id)), 0), 6) AS p FROM sims")
def l2_normalised_similarity(spark, sf_dir):
    """Pairs are summed twice, for the items' lengths and for the rows, rather than written out and read."""
    counted, lengths, few, scale = _counted(spark, sf_dir, similarity.NEEDS[_ALIGN_BY])
    texts = graph.checkpointed(lengths(counted))
    parts = similarity.local_statistics(texts, few, scale, _ALIGN_BY, DUMMY_SENTENCE, _ALIGN_DIGITS)
    sizes = dict(parts.filter("t_sq is not null").groupBy("elem_id").agg(F.sqrt(F.sum("t_sq"))).collect())  # one row for each item
    return similarity.local_similarities(texts, few, scale, _ALIGN_BY, digits=6, lengths=sizes).withColumnRenamed("sim", "p")


from . import engine_queries, evaluation_queries, linguistic_queries  # noqa: E402, F401  # register their queries
