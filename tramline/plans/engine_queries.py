"""Registered queries of the feature extractors, each with its SQL.

benchmark items are sentences and parts are elements of four cases; what an analyser would say of a word is derived from
its length and place by a fixed rule, on both sides of the check alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, graph
from .queries import CONFIG, _r, _read, query

_W = CONFIG.weights()


def _annotated(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Words of a text with their place, and with annotations made by rule."""
    words = df.select(*keys, F.posexplode(T.tokens(F.coalesce(text, F.lit("")))).alias("tok_id", "lemma"))
    n, at = F.length("lemma"), F.col("tok_id")
    pos = F.when(n % 4 == 0, "noun").when(n % 4 == 1, "verb").when(n % 4 == 2, "adjective").otherwise("determiner")
    return words.select(
        "*", F.col("lemma").alias("form"), pos.alias("pos"), F.when(at % 5 == 0, "A0").when(at % 5 == 1, "A1").alias("role"), (at % 10 < 2).alias("is_head"),
        ((n % 4 == 1) & (at % 3 == 0)).alias("is_predicate"), (at % 7 < 2).alias("in_condition"), F.when(n % 6 != 0, F.substring("lemma", 1, 2)).alias("wn"), (at % 3 + 0.5).alias("tfidf"),
    )


def _annotated_sql(name: str, source: str, keys: str, text: str) -> str:
    return f"""{name}_raw AS (SELECT {keys}, unnest(l) AS lemma, generate_subscripts(l, 1) AS p FROM (SELECT *, regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+') AS l FROM {source})),
{name}_at AS (SELECT {keys}, lemma, row_number() OVER (PARTITION BY {keys} ORDER BY p) - 1 AS tok_id FROM {name}_raw WHERE lemma <> ''),
{name} AS (SELECT *, CASE length(lemma) % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' WHEN 2 THEN 'adjective' ELSE 'determiner' END AS pos, CASE tok_id % 5 WHEN 0 THEN 'A0' WHEN 1 THEN 'A1' END AS role, tok_id % 10 < 2 AS is_head,
  length(lemma) % 4 = 1 AND tok_id % 3 = 0 AS is_predicate, tok_id % 7 < 2 AS in_condition, CASE WHEN length(lemma) % 6 <> 0 THEN substr(lemma, 1, 2) END AS wn, tok_id % 3 + 0.5 AS tfidf FROM {name}_at)"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What plans.align hands to the extractors."""
    sentences = _read(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.col("item_id") % 4).alias("case_id"), F.col("item_id").alias("sent_id"), "text")
    kind = F.when(F.col("p_size") % 4 < 2, "Task").when(F.col("p_size") % 4 == 2, "Event").otherwise("Gateway")
    part = _read(spark, sf_dir, "part").select("*", F.concat(F.lit("c"), F.col("p_partkey") % 4).alias("case_id"), F.col("p_partkey").cast("string").alias("elem_id"), kind.alias("elem_type"))
    gate = F.when(F.col("p_partkey") % 3 == 0, "exclusiveGateway").when(F.col("p_partkey") % 3 == 1, "parallelGateway").otherwise("inclusiveGateway")
    elements = part.select("case_id", F.lit("p").alias("process_id"), "elem_id", "elem_type", F.when(F.col("elem_type") == "Gateway", gate).otherwise(F.lower("elem_type")).alias("tag"), F.col("p_name").alias("name"))
    steps = part.select("case_id", F.col("elem_id").alias("src"), "p_type", "p_partkey", F.explode(F.array(F.lit(4), F.lit(8))).alias("_by"))
    edges = steps.select("case_id", F.concat_ws(">", "src", "_by").alias("flow_id"), "src", (F.col("p_partkey") + F.col("_by")).cast("string").alias("dst"), "p_type")
    edges = edges.join(elements.select("case_id", F.col("elem_id").alias("dst")), ["case_id", "dst"])
    labels = part.select("case_id", "elem_id", "elem_type", F.col("p_name").alias("name"))
    labels = labels.unionByName(edges.select("case_id", F.col("flow_id").alias("elem_id"), F.lit("Flow").alias("elem_type"), F.col("p_type").alias("name")))
    labels = labels.unionByName(part.select("case_id", F.col("p_brand").alias("elem_id"), F.lit("Lane").alias("elem_type"), F.concat_ws(" ", "p_brand", F.lit("crew")).alias("name")).distinct())
    parents = _read(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("child"), F.lower(F.substring("n_name", 3, 2)).alias("parent")).distinct()
    return {
        "tokens": _annotated(sentences, ["case_id", "sent_id"], "text"), "elements": elements, "edges": edges.drop("p_type"), "label_tokens": _annotated(labels, ["case_id", "elem_id", "elem_type"], "name"),
        "holders": part.select("case_id", F.col("p_brand").alias("holder_id"), "elem_id"), "hypernyms": features.hypernym_chain(parents, CONFIG.hypernym_chain_length),
    }


_SQL = f"""WITH se AS (SELECT 'c' || (item_id % 4) AS case_id, item_id AS sent_id, text FROM benchmark),
el AS (SELECT 'c' || (p_partkey % 4) AS case_id, p_partkey::VARCHAR AS elem_id, CASE WHEN p_size % 4 < 2 THEN 'Task' WHEN p_size % 4 = 2 THEN 'Event' ELSE 'Gateway' END AS elem_type, p_partkey, p_name, p_type, p_brand FROM part),
ed AS (SELECT a.case_id, a.elem_id || '>' || k AS flow_id, a.elem_id AS src, b.elem_id AS dst, a.p_type FROM el a CROSS JOIN (VALUES (4), (8)) v(k) JOIN el b ON b.p_partkey = a.p_partkey + k AND b.case_id = a.case_id),
la AS (SELECT case_id, elem_id, elem_type, p_name AS name FROM el UNION ALL SELECT case_id, flow_id, 'Flow', p_type FROM ed UNION ALL SELECT DISTINCT case_id, p_brand, 'Lane', p_brand || ' crew' FROM el),
pa AS (SELECT DISTINCT lower(substr(n_name, 1, 2)) AS child, lower(substr(n_name, 3, 2)) AS parent FROM nation),
ch AS (SELECT node, ancestor, min(step) AS step FROM (SELECT child AS node, parent AS ancestor, 0 AS step FROM pa UNION ALL SELECT a.child, b.parent, 1 FROM pa a JOIN pa b ON a.parent = b.child UNION ALL SELECT a.child, c.parent, 2 FROM pa a JOIN pa b ON a.parent = b.child JOIN pa c ON b.parent = c.child) GROUP BY node, ancestor),
{_annotated_sql("tk", "se", "case_id, sent_id", "text")},
{_annotated_sql("lt", "la", "case_id, elem_id, elem_type", "name")},
tc AS (SELECT * FROM tk WHERE pos <> 'determiner'), lc AS (SELECT * FROM lt WHERE pos <> 'determiner'),
li AS (SELECT l.*, tok_id = max(tok_id) OVER (PARTITION BY case_id, elem_id) AS last FROM lc l WHERE elem_type = 'Lane'),
wh AS (SELECT el.case_id, el.elem_id, li.lemma, li.pos, li.tfidf, li.last FROM el JOIN li ON li.case_id = el.case_id AND li.elem_id = el.p_brand WHERE el.elem_type IN ('Task', 'Event'))"""


def _lemma(owner: str, source: str, family: str, args: str, times: str = "tfidf", where: str = "true") -> str:
    return f"SELECT case_id, {owner}, '{family}' AS ftype, {args} AS arg, {_W[family]} * {times} AS weight FROM {source} WHERE {where}"


def _senses(owner: str, source: str, where: str = "true") -> list[str]:
    up = f"SELECT case_id, {owner}, 'has-parent-synset', ancestor, {_W['has-parent-synset']} * tfidf * pow({CONFIG.hypernym_multiplier}, step) FROM {source} JOIN ch ON wn = node WHERE {where}"
    return [_lemma(owner, source, "has-synset", "coalesce(wn, '?')", where=where), up]


def _roles(owner: str, role: str, who: str, all_: str, content: str, where: str = "true") -> list[str]:
    return [_lemma(owner, all_, f"{who}-head", "lemma || '|' || pos", where=f"role = '{role}' AND is_head AND {where}"), _lemma(owner, content, f"in-{who}", "lemma || '|' || pos", where=f"role = '{role}' AND {where}")]


_LABELLED, _GATES = "elem_type IN ('Task', 'Event')", "elem_type = 'Gateway'"
#: By extractor: the features of each family.
_TEXT_SQL = {
    "forms": [_lemma("sent_id", "tc", "has-form", "lemma")],
    "lemmas": [_lemma("sent_id", "tc", "has-lemma", "pos || '|' || lemma")],
    "synsets": _senses("sent_id", "tc"),
    "conditionals": [_lemma("sent_id", "tc", "lemma-conditional-follow", "lemma || '|' || pos", "1", "in_condition")],
    "actions": [_lemma("sent_id", "tk", "has-action", "lemma", "1", "is_predicate")],
    "agents": _roles("sent_id", "A0", "agent", "tk", "tc"),
    "patients": _roles("sent_id", "A1", "patient", "tk", "tc"),
}
_MODEL_SQL = {
    "label_forms": [_lemma("elem_id", "lc", "has-form", "lemma", where=_LABELLED)],
    "label_lemmas": [_lemma("elem_id", "lc", "has-lemma", "pos || '|' || lemma", where=f"({_LABELLED} OR {_GATES})")],
    "label_synsets": _senses("elem_id", "lc", _LABELLED),
    "gateway_markers": [f"SELECT case_id, elem_id, 'has-discourse-marker' AS ftype, CASE p_partkey % 3 WHEN 0 THEN 'conditional' ELSE 'parallel' END AS arg, {_W['has-discourse-marker']} AS weight FROM el WHERE {_GATES} AND p_partkey % 3 < 2"],
    "label_actions": [_lemma("elem_id", "lt", "has-action", "lemma", where=f"is_predicate AND {_LABELLED}")],
    "branch_lemmas": [f"SELECT ed.case_id, el.elem_id, 'has-lemma' AS ftype, pos || '|' || lemma AS arg, {_W['has-lemma']} * tfidf AS weight FROM ed JOIN el ON el.case_id = ed.case_id AND el.elem_id = ed.src AND el.elem_type = 'Gateway' JOIN lc ON lc.case_id = ed.case_id AND lc.elem_id = ed.flow_id AND lc.elem_type = 'Flow'"],
    "performers": [_lemma("elem_id", "wh", "agent-head", "lemma || '|' || pos", where="last"), _lemma("elem_id", "wh", "in-agent", "lemma || '|' || pos")],
    "label_patients": _roles("elem_id", "A1", "patient", "lt", "lc", _LABELLED),
    "gateway_context": [
        f"SELECT ed.case_id, own.elem_id, '{family}' AS ftype, lemma || '|' || pos AS arg, {_W[family]} AS weight FROM ed JOIN el own ON own.case_id = ed.case_id AND own.elem_id = ed.{near} AND own.{_LABELLED} JOIN lc ON lc.case_id = ed.case_id AND lc.elem_id = ed.{far} AND lc.{_GATES}"
        for near, far, family in (("dst", "src", "lemma-conditional-follow"), ("src", "dst", "lemma-conditional-pred"))
    ],
}


def _register(side: str, name: str, extractor, owner: str, parts: list[str]) -> None:
    @query(f"{side}_{name}", f"{_SQL} SELECT case_id, {owner}, ftype, arg, round(max(weight), 6)::DOUBLE AS weight FROM ({' UNION ALL '.join(parts)}) GROUP BY case_id, {owner}, ftype, arg")
    def run(spark, sf_dir):
        out = features.extract({name: extractor}, CONFIG, _tables(spark, sf_dir), ["case_id", owner])
        return out.select("case_id", owner, "ftype", F.translate("arg", "\u0001\u0000", "|?").alias("arg"), _r("weight").alias("weight"))


for _name, _parts in _TEXT_SQL.items():
    _register("text", _name, features.TEXT_EXTRACTORS[_name], "sent_id", _parts)
for _name, _parts in _MODEL_SQL.items():
    _register("model", _name, features.MODEL_EXTRACTORS[_name], "elem_id", _parts)


_MARKER_ROWS = ", ".join(f"('{kind}', '{m}', {m.count('_') + 1})" for kind, markers in features.MARKERS.items() for m in markers)
_MARKER_SQL = f"""WITH se AS (SELECT conv_id AS case_id, turn AS sent_id, text FROM conversations), {_annotated_sql("tk", "se", "case_id, sent_id", "text")},
mk(kind, marker, n) AS (VALUES {_MARKER_ROWS}),
gr AS (SELECT case_id, sent_id, 1 AS n, lemma AS words FROM tk UNION ALL SELECT a.case_id, a.sent_id, 2, a.lemma || '_' || b.lemma FROM tk a JOIN tk b USING (case_id, sent_id) WHERE b.tok_id = a.tok_id + 1
  UNION ALL SELECT a.case_id, a.sent_id, 3, a.lemma || '_' || b.lemma || '_' || c.lemma FROM tk a JOIN tk b USING (case_id, sent_id) JOIN tk c USING (case_id, sent_id) WHERE b.tok_id = a.tok_id + 1 AND c.tok_id = a.tok_id + 2
  UNION ALL SELECT a.case_id, a.sent_id, 4, a.lemma || '_' || b.lemma || '_' || c.lemma || '_' || d.lemma FROM tk a JOIN tk b USING (case_id, sent_id) JOIN tk c USING (case_id, sent_id) JOIN tk d USING (case_id, sent_id) WHERE b.tok_id = a.tok_id + 1 AND c.tok_id = a.tok_id + 2 AND d.tok_id = a.tok_id + 3)
SELECT DISTINCT case_id, sent_id, kind AS marker FROM gr JOIN mk ON gr.n = mk.n AND words = marker"""


@query("text_discourse_markers", _MARKER_SQL)
def text_discourse_markers(spark, sf_dir):
    """Markers of one and of several words in the turns of conversations."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("sent_id"), "text")
    found = features.marker_features(_annotated(turns, ["case_id", "sent_id"], "text"), ["case_id", "sent_id"], CONFIG)
    return found.select("case_id", "sent_id", F.col("arg").alias("marker")).distinct()


@query("explained_features", f"{_SQL} SELECT DISTINCT case_id, sent_id, 'Contains the ' || pos || ' \"' || lemma || '\"' AS said FROM tc")
def explained_features(spark, sf_dir):
    """Features in words."""
    found = features.extract({"lemmas": features.TEXT_EXTRACTORS["lemmas"]}, CONFIG, _tables(spark, sf_dir), ["case_id", "sent_id"])
    return found.select("case_id", "sent_id", features.explain(F.col("ftype"), F.col("arg"), CONFIG).alias("said")).distinct()


@query("element_lookups", f"{_SQL} SELECT el.case_id, el.elem_id, el.p_brand AS holder_id, count(ed.flow_id)::BIGINT AS n_out FROM el LEFT JOIN ed ON ed.case_id = el.case_id AND ed.src = el.elem_id GROUP BY el.case_id, el.elem_id, el.p_brand")
def element_lookups(spark, sf_dir):
    """Elements with their lane and the number of flows out."""
    t = _tables(spark, sf_dir)
    out = graph.degrees(t["edges"], ["case_id"]).select("case_id", F.col("node").alias("elem_id"), "n_out")
    return t["holders"].join(out, ["case_id", "elem_id"], "left").select("case_id", "elem_id", "holder_id", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


@query("reversed_edges", f"{_SQL}, no AS (SELECT case_id, src AS node FROM ed UNION SELECT case_id, dst FROM ed) SELECT ed.case_id, ed.dst AS src, ed.src AS dst, (SELECT count(*) FROM no WHERE no.case_id = ed.case_id)::BIGINT AS n_nodes FROM ed")
def reversed_edges(spark, sf_dir):
    """Edges turned round, with the number of vertices of the case."""
    edges = _tables(spark, sf_dir)["edges"].select("case_id", "src", "dst")
    sizes = graph.degrees(edges, ["case_id"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return graph.reverse(edges).join(sizes, "case_id").select("case_id", "src", "dst", "n_nodes")
