"""Registered queries of predicate tables, tree patterns, label charts, tag sequences, senses, the analysis cache and n-way comparison.

Annotations that an analyser would give are derived from words' lengths and places by a fixed rule, on both sides alike:
the SQL checks the joins, folds and charts, not an analysis.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chart, evaluate, graph, senses, spans
from ..sources import cache
from .engine_queries import _annotated, _annotated_sql
from .queries import _read, _r, query

_S = ["case_id", "sent_id"]


# ---------------------------------------------------------------- predicates and arguments


def _sentences(spark, sf_dir) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select(F.lit("c").alias("case_id"), F.col("item_id").alias("sent_id"), "text")
    vform = F.get(F.array(*map(F.lit, ("personal", "gerund", "participle", "infinitive"))), (F.col("tok_id") % 4).cast("int"))
    return _annotated(items, _S, "text").withColumn("vform", vform)


def _predicates(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every word marked as predicate, with an argument on each side; those of neighbours overlap."""
    preds = tokens.filter("is_predicate").select(*_S, F.col("tok_id").alias("pred_id"), F.col("tok_id").alias("head_tok"), F.length("lemma").alias("n"))
    before = preds.select(*_S, "pred_id", F.lit("A0").alias("role"), (F.col("pred_id") - 1).alias("head_tok"), (F.col("pred_id") - 3 - F.col("n") % 3).alias("from_tok"), (F.col("pred_id") - 1).alias("to_tok"))
    after = preds.select(*_S, "pred_id", F.lit("A1").alias("role"), (F.col("pred_id") + 2).alias("head_tok"), (F.col("pred_id") + 1).alias("from_tok"), (F.col("pred_id") + 2 + F.col("n")).alias("to_tok"))
    return preds.drop("n"), before.unionByName(after)


_PRED_SQL = f"""WITH se AS (SELECT 'c' AS case_id, item_id AS sent_id, text FROM benchmark), {_annotated_sql("tk", "se", "case_id, sent_id", "text")},
pr AS (SELECT sent_id, tok_id, length(lemma) AS n FROM tk WHERE is_predicate AND pos = 'verb' AND tok_id % 4 <> 1),
ar AS (SELECT sent_id, 'A0' AS role, tok_id - 1 AS head, tok_id - 3 - n % 3 AS a, tok_id - 1 AS b FROM pr UNION ALL SELECT sent_id, 'A1', tok_id + 2, tok_id + 1, tok_id + 2 + n FROM pr)"""


@query("argument_tokens", f"""{_PRED_SQL} SELECT tk.sent_id, tk.tok_id, tk.lemma, ar.role, bool_or(tk.tok_id = ar.head) AS is_head, bool_or(tk.tok_id BETWEEN ar.a AND ar.b) AS in_role
FROM tk JOIN ar ON tk.sent_id = ar.sent_id AND (tk.tok_id BETWEEN ar.a AND ar.b OR tk.tok_id = ar.head) WHERE tk.pos <> 'determiner' GROUP BY tk.sent_id, tk.tok_id, tk.lemma, ar.role""")
def argument_tokens(spark, sf_dir):
    """The words of arguments by a binned range join; a word may stand in several roles."""
    tokens = _sentences(spark, sf_dir)
    return spans.role_tokens(*_predicates(tokens), tokens).select("sent_id", "tok_id", "lemma", "role", "is_head", "in_role")


@query("relevant_predicates", f"{_PRED_SQL} SELECT sent_id, tok_id AS pred_id FROM pr")
def relevant_predicates(spark, sf_dir):
    """Predicates of verbs in a personal, participle or infinitive form."""
    tokens = _sentences(spark, sf_dir)
    return spans.relevant_predicates(_predicates(tokens)[0], tokens).select("sent_id", "pred_id")


# ---------------------------------------------------------------- trees


def _trees(spark, sf_dir) -> DataFrame:
    """Clauses of six words; an odd one opens with an adverb node, and every word of even length that opens one is "if"."""
    w = _sentences(spark, sf_dir).select(*_S, "tok_id", "lemma", F.floor(F.col("tok_id") / 6).alias("c"), (F.col("tok_id") % 6).alias("w"))
    w = w.withColumn("odd", (F.col("c") + F.col("sent_id")) % 2 == 1).withColumn("top", 1 + F.col("c") * 8)
    none = F.lit(None)
    tops = w.filter("w = 0").select(*_S, F.col("top").alias("node"), (F.col("top") + 7).alias("last"), F.lit(0).alias("parent"), F.col("c").alias("nth"), F.when(F.col("odd"), "claus").otherwise("sub-cl").alias("label"), none.cast("int").alias("tok_id"), none.cast("string").alias("word"))
    advs = w.filter("w = 0 and odd").select(*_S, (F.col("top") + 1).alias("node"), (F.col("top") + 2).alias("last"), F.col("top").alias("parent"), F.lit(0).alias("nth"), F.lit("adv").alias("label"), none.cast("int").alias("tok_id"), none.cast("string").alias("word"))
    under = F.col("odd") & (F.col("w") == 0)
    word = F.when((F.col("w") == 0) & (F.length("lemma") % 2 == 0), "If").otherwise(F.col("lemma"))
    at = F.col("top") + 2 + F.col("w")
    leaves = w.select(*_S, at.alias("node"), at.alias("last"), F.when(under, F.col("top") + 1).otherwise(F.col("top")).alias("parent"), F.col("w").alias("nth"), F.when(F.length("lemma") % 7 == 0, "sf-brk").otherwise("w").alias("label"), "tok_id", word.alias("word"))
    return tops.unionByName(advs).unionByName(leaves)


@query("condition_tokens", f"""WITH se AS (SELECT 'c' AS case_id, item_id AS sent_id, text FROM benchmark), {_annotated_sql("tk", "se", "case_id, sent_id", "text")},
w AS (SELECT sent_id, tok_id, length(lemma) AS n, tok_id // 6 AS c, tok_id % 6 AS w FROM tk),
opened AS (SELECT sent_id, c FROM w WHERE w = 0 AND n % 2 = 0),
stops AS (SELECT sent_id, c, min(w) AS stop FROM w WHERE w > 0 AND n % 7 = 0 GROUP BY sent_id, c)
SELECT w.sent_id, w.tok_id FROM w JOIN opened o ON o.sent_id = w.sent_id AND o.c = w.c LEFT JOIN stops s ON s.sent_id = w.sent_id AND s.c = w.c WHERE w.w > 0 AND (s.stop IS NULL OR w.w < s.stop)""")
def condition_tokens(spark, sf_dir):
    """Words of conditions, found by ancestor-descendant joins over constituent trees."""
    return spans.condition_tokens(_trees(spark, sf_dir)).select("sent_id", "tok_id")


@query("tree_roots", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
up AS (SELECT node, node AS root, 0 AS depth FROM o WHERE parent IS NULL UNION ALL SELECT o.node, up.root, up.depth + 1 FROM o JOIN up ON o.parent = up.node)
SELECT o_custkey, up.node, up.root, up.depth::BIGINT AS depth FROM up JOIN o ON o.node = up.node""")
def tree_roots(spark, sf_dir):
    """Roots and depths by pointer jumping: an order's parent is the customer's order before."""
    from pyspark.sql import Window

    orders = _read(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    parents = orders.select("o_custkey", F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(own).alias("parent"))
    return spans.ancestors(parents, ["o_custkey"]).select("o_custkey", "node", "root", "depth")


# ---------------------------------------------------------------- charts and tags

_TAGS = ("NN", "JJ", "IN", "CC", "VB", "NNA", "DT", "TO")


def _tags(spark, sf_dir) -> DataFrame:
    """The words of a part's name, type and brand with a tag by length and place; some have a second one."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_size", F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("at", "word"))
    by = F.length("word") + F.col("p_size") + 3 * F.col("at")
    first = F.when((F.col("at") == 0) & (F.col("p_size") % 3 < 2), F.when(F.col("p_size") % 3 == 0, "VB").otherwise("NNA")).otherwise(F.get(F.array(*map(F.lit, _TAGS)), (by % 8).cast("int")))
    both = F.when(by % 5 == 0, F.array(first, F.lit("VBN"))).otherwise(F.array(first))
    return part.select("p_partkey", "at", F.explode(both).alias("tag"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" for c in r) + ")" for r in rows)


_TAG_SQL = f"""pw AS (SELECT p_partkey, p_size, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS k FROM (SELECT *, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS l FROM part)),
tg AS (SELECT p_partkey, k, CASE WHEN k = 0 AND p_size % 3 = 0 THEN 'VB' WHEN k = 0 AND p_size % 3 = 1 THEN 'NNA' ELSE [{", ".join(f"'{t}'" for t in _TAGS)}][(length(word) + p_size + 3 * k) % 8 + 1] END AS tag FROM pw
  UNION SELECT p_partkey, k, 'VBN' FROM pw WHERE (length(word) + p_size + 3 * k) % 5 = 0)"""


def _chart_sql(most: int) -> str:
    """Charts span by span, up to `most` words; chains of single symbols by recursion."""
    one = _values(sorted({(s, b[0]) for s, bodies in chart.LABELS.items() for b in bodies if len(b) == 1}))
    steps = "".join(f"""
c{n} AS (SELECT DISTINCT a.p_partkey, up.symbol, a.i, b.j FROM u{n - 1} a JOIN u{n - 1} b ON a.p_partkey = b.p_partkey AND a.j = b.i AND b.j - a.i = {n} JOIN two ON two.l = a.symbol AND two.r = b.symbol JOIN up ON up.part = two.symbol),
u{n} AS (SELECT * FROM u{n - 1} UNION ALL SELECT * FROM c{n}),""" for n in range(2, most + 1))
    return f"""WITH RECURSIVE {_TAG_SQL}, one(symbol, part) AS (VALUES {one}), two(symbol, l, r) AS (VALUES {_values(chart.pairs(chart.LABELS))}),
syms AS (SELECT symbol AS s FROM one UNION SELECT part FROM one UNION SELECT symbol FROM two UNION SELECT l FROM two UNION SELECT r FROM two),
up(symbol, part) AS (SELECT s, s FROM syms UNION SELECT one.symbol, up.part FROM up JOIN one ON one.part = up.symbol),
u1 AS (SELECT DISTINCT p_partkey, coalesce(up.symbol, tag) AS symbol, k AS i, k + 1 AS j FROM tg LEFT JOIN up ON up.part = tag),{steps}
len AS (SELECT p_partkey, max(k) + 1 AS n FROM tg GROUP BY p_partkey)"""


_WORDS = 4


@query("label_charts", f"{_chart_sql(_WORDS)} SELECT p_partkey, symbol, i::INTEGER AS i, j::INTEGER AS j FROM u{_WORDS}")
def label_charts(spark, sf_dir):
    """All phrases of all labels."""
    return chart.parse(_tags(spark, sf_dir), ["p_partkey"]).select("p_partkey", "symbol", "i", "j")


_PLACE = "CASE symbol " + " ".join(f"WHEN '{t}' THEN {n}" for n, t in enumerate(chart.TOPS)) + " END"
_NAME = "CASE min(p) " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(chart.TOPS)) + " END"


@query("label_tops", f"{_chart_sql(_WORDS)}, w AS (SELECT u.p_partkey, {_PLACE} AS p FROM u{_WORDS} u JOIN len ON len.p_partkey = u.p_partkey WHERE i = 0 AND j = n) SELECT len.p_partkey, {_NAME} AS top FROM len LEFT JOIN w ON w.p_partkey = len.p_partkey GROUP BY len.p_partkey")
def label_tops(spark, sf_dir):
    """What each label is as a whole."""
    tags = _tags(spark, sf_dir)
    lengths = tags.groupBy("p_partkey").agg((F.max("at") + 1).alias("n"))
    return chart.tops(chart.parse(tags, ["p_partkey"]), lengths, ["p_partkey"])


_MOVES = {(a, b): -((3 * i + 5 * j) % 11) for i, a in enumerate(("^", *_TAGS, "VBN")) for j, b in enumerate((*_TAGS, "VBN")) if (i + j) % 9}
_MOVE_SQL = ", ".join(f"('{a}', '{b}', {s})" for (a, b), s in _MOVES.items())


@query("best_tag_sequences", f"""WITH RECURSIVE {_TAG_SQL}, mv(a, b, s) AS (VALUES {_MOVE_SQL}), len AS (SELECT p_partkey, max(k) + 1 AS n FROM tg GROUP BY p_partkey),
sq AS (SELECT p_partkey, 0::BIGINT AS k, ''::VARCHAR AS path, '^'::VARCHAR AS last, 0::BIGINT AS cost FROM len
  UNION ALL SELECT sq.p_partkey, sq.k + 1, ltrim(sq.path || ' ' || tg.tag), tg.tag, sq.cost + length(tg.tag) - coalesce(mv.s, -1000000) FROM sq JOIN tg ON tg.p_partkey = sq.p_partkey AND tg.k = sq.k LEFT JOIN mv ON mv.a = sq.last AND mv.b = tg.tag),
rk AS (SELECT sq.p_partkey, cost, path, row_number() OVER (PARTITION BY sq.p_partkey ORDER BY cost, path) AS nth FROM sq JOIN len ON len.p_partkey = sq.p_partkey AND k = n)
SELECT p_partkey, nth::INTEGER AS nth, cost::BIGINT AS cost, path FROM rk WHERE nth <= 3""")
def best_tag_sequences(spark, sf_dir):
    """The three best sequences of tags of each label; the SQL lists all of them."""
    places = _tags(spark, sf_dir).groupBy("p_partkey", "at").agg(F.collect_set(F.struct("tag", (-F.length("tag")).cast("bigint").alias("score"))).alias("tags"))
    lattice = places.groupBy("p_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tags"))), lambda p: p["tags"]).alias("lattice"))
    best = lattice.select("p_partkey", F.posexplode(chart.k_best(F.col("lattice"), _MOVES, 3)).alias("nth", "s"))
    return best.select("p_partkey", (F.col("nth") + 1).cast("int").alias("nth"), "s.cost", "s.path")


# ---------------------------------------------------------------- senses

_ROUNDS = 4
_RANK_SQL = """WITH ed AS (SELECT DISTINCT 'p' || l_partkey AS child, 's' || l_suppkey AS parent FROM lineitem UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
deg AS (SELECT child, count(*) AS n FROM ed GROUP BY child), no AS (SELECT child AS node FROM ed UNION SELECT parent FROM ed), size AS (SELECT count(*) AS n FROM no),
r0 AS (SELECT node, 1.0::DOUBLE / (SELECT n FROM size) AS rank FROM no)""" + "".join(f""",
l{k} AS (SELECT sum(rank) AS loose FROM r{k - 1} WHERE node NOT IN (SELECT child FROM deg)),
g{k} AS (SELECT ed.parent AS node, sum(r.rank / deg.n) AS got FROM ed JOIN deg ON deg.child = ed.child JOIN r{k - 1} r ON r.node = ed.child GROUP BY ed.parent),
r{k} AS (SELECT no.node, (1 - 0.85::DOUBLE) / (SELECT n FROM size) + 0.85::DOUBLE * (SELECT loose FROM l{k}) / (SELECT n FROM size) + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM no LEFT JOIN g{k} ON g{k}.node = no.node)""" for k in range(1, _ROUNDS + 1))


def _graph(spark, sf_dir) -> DataFrame:
    """Parts below their suppliers, suppliers below nations, nations below regions."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    rows = [("lineitem", "p", "l_partkey", "s", "l_suppkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    out = None
    for table, a, child, b, parent in rows:
        own = _read(spark, sf_dir, table).select(named(a, child).alias("child"), named(b, parent).alias("parent"))
        out = own if out is None else out.unionByName(own)
    return out


@query("sense_ranks", f"{_RANK_SQL} SELECT node, round(rank, 9) AS rank FROM r{_ROUNDS}")
def sense_ranks(spark, sf_dir):
    """Ranks over a hypernym graph after a fixed number of rounds."""
    return senses.page_rank(_graph(spark, sf_dir), _ROUNDS).select("node", _r("rank", 9).alias("rank"))


# A word is a name of a part; its senses are the suppliers of all parts of that name.
@query("best_senses", f"{_RANK_SQL}, se AS (SELECT DISTINCT p_name AS lemma, 's' || l_suppkey AS node FROM lineitem JOIN part ON p_partkey = l_partkey), rk AS (SELECT lemma, se.node, row_number() OVER (PARTITION BY lemma ORDER BY round(rank, 12) DESC, se.node) AS nth FROM se JOIN r{_ROUNDS} r ON r.node = se.node) SELECT lemma, node || '-n' AS wn FROM rk WHERE nth = 1")
def best_senses(spark, sf_dir):
    """The best-ranked sense of each word."""
    held = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    table = held.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-n")).alias("wn")).agg(F.collect_set("p_name").alias("senses"))
    ranks = senses.page_rank(_graph(spark, sf_dir), _ROUNDS).select(F.concat("node", F.lit("-n")).alias("node"), _r("rank", 12).alias("rank"))
    return senses.best_senses(table, ranks).select("lemma", "wn")


# ---------------------------------------------------------------- cache and comparison


@query("analysis_cache", """WITH t AS (SELECT conv_id, turn, text, coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS k FROM conversations)
SELECT conv_id, turn, sha256(k || '|2:en') AS key, length(text)::INTEGER AS n_chars, (SELECT count(DISTINCT k) FROM t WHERE turn < 2)::BIGINT AS first_new,
  ((SELECT count(DISTINCT k) FROM t) - (SELECT count(DISTINCT k) FROM t WHERE turn < 2))::BIGINT AS then_new, 0::BIGINT AS last_new FROM t""")
def analysis_cache(spark, sf_dir):
    """The first turns are analysed, then all: only what is new is; then all again: nothing is."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("en").alias("lang"))
    path = f"{graph.shared_folder(spark)}/analysis-{uuid.uuid4().hex}"
    measure = lambda texts: texts.select("key", "prefix", F.length("text").alias("n_chars"))
    new = [cache.cached(spark, path, some, ["text", "lang"], measure, "n_chars int", stamp) for stamp, some in enumerate((turns.filter("turn < 2"), turns, turns))]
    counts = [F.lit(n).cast("bigint").alias(name) for (_, n), name in zip(new, ("first_new", "then_new", "last_new"))]
    return new[-1][0].select("conv_id", "turn", "key", "n_chars", *counts)


@query("gt_compare_many", """WITH b AS (SELECT source AS case_id, d.doc_id AS elem_id, CASE WHEN quality = 1 THEN (d.doc_id % 7)::VARCHAR ELSE 'm' END AS a0, CASE WHEN toxic = 0 THEN (d.doc_id % 7)::VARCHAR ELSE 'm' END AS a1 FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
u AS (SELECT case_id, elem_id, 1 AS bit, a0 AS a FROM b UNION ALL SELECT case_id, elem_id, 2, a1 FROM b UNION ALL SELECT source, doc_id, 4, (doc_id % 3)::VARCHAR FROM documents WHERE n_chars % 2 = 0),
s AS (SELECT case_id, elem_id, a, sum(bit) AS bits, count(*) AS n FROM u GROUP BY case_id, elem_id, a),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, elem_id ORDER BY n DESC, a) AS nth, sum(bits) OVER (PARTITION BY case_id, elem_id) AS held FROM s)
SELECT case_id, elem_id, held::BIGINT AS held, bits::BIGINT AS agree, a AS answer, held <> 7 AS one_sided FROM r WHERE nth = 1""")
def gt_compare_many(spark, sf_dir):
    """Three annotators, one of whom saw other documents."""
    docs = _read(spark, sf_dir, "documents")
    both = _read(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("elem_id"), "quality", "toxic")
    place = F.col("elem_id") % 7
    one = both.select("case_id", "elem_id", F.when(F.col("quality") == 1, place).alias("sent_id"), F.when(F.col("quality") == 0, "m").alias("err"))
    two = both.select("case_id", "elem_id", F.when(F.col("toxic") == 0, place).alias("sent_id"), F.when(F.col("toxic") == 1, "m").alias("err"))
    three = docs.filter("n_chars % 2 = 0").select(F.col("source").alias("case_id"), F.col("doc_id").alias("elem_id"), (F.col("doc_id") % 3).alias("sent_id"), F.lit(None).cast("string").alias("err"))
    return evaluate.compare_many({"one": one, "two": two, "three": three})
