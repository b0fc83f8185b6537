"""Predicates, trees, charts, tag sequences, senses, the analysis cache and n-way comparison on small examples."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import BPMN, TEXT, rows
from tramline.config import Config
from tramline.operators import analysis, chart, evaluate, graph, senses, spans
from tramline.plans import align
from tramline.sources import cache


def test_range_join_against_every_pair(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randint(-40, 200)) for _ in range(300)] + [("a", None), (None, 3)]
    ranges = [(rng.choice("ab"), (a := rng.randint(-50, 200)), a + rng.randint(-3, 60)) for _ in range(60)] + [("a", 0, None), (None, 0, 9)]
    p, r = spark.createDataFrame(points, "k string, x int"), spark.createDataFrame(ranges, "k string, lo int, hi int")
    expected = sorted((k, x, lo, hi) for k, x in points for j, lo, hi in ranges if None not in (k, x, lo, hi) and k == j and lo <= x <= hi)
    for width in (1, 7, 1000):
        assert rows(spans.range_join(p, r, ["k"], "x", "lo", "hi", width), "k", "x", "lo", "hi") == expected


def tokens_of(spark, sentence, **more):
    """(form, pos, vform) triples of one sentence as tokens."""
    data = [("c", 1, "s", i, form, form.lower(), pos, vform, None, None, None, None, False, False, False) for i, (form, pos, vform) in enumerate(sentence)]
    return spark.createDataFrame(data, f"case_id string, sent_id int, sentence string, {analysis.TOKENS}")


SENTENCE = [("clerk", "noun", None), ("sends", "verb", "personal"), ("order", "noun", None), ("to", "particle", None), ("warehouse", "noun", None), ("picking", "verb", "gerund"), ("goods", "noun", None)]
PREDICATES = [("c", 1, "p1", 1), ("c", 1, "p2", 5)]
ARGUMENTS = [("c", 1, "p1", "A0", 0, 0, 0), ("c", 1, "p1", "A1", 2, 2, 4), ("c", 1, "p1", "A0", 4, 3, 4), ("c", 1, "p2", "A1", 6, 6, 6)]
_P, _A = "case_id string, sent_id int, pred_id string, head_tok int", "case_id string, sent_id int, pred_id string, role string, head_tok int, from_tok int, to_tok int"


def test_roles_of_overlapping_arguments(spark):
    tokens, preds, args = tokens_of(spark, SENTENCE), spark.createDataFrame(PREDICATES, _P), spark.createDataFrame(ARGUMENTS, _A)
    assert rows(spans.relevant_predicates(preds, tokens), "pred_id") == [("p1",)]  # a gerund is none
    got = rows(spans.role_tokens(preds, args, tokens), "tok_id", "role", "is_head", "in_role")
    assert got == [(0, "A0", True, True), (2, "A1", True, True), (4, "A0", True, True), (4, "A1", False, True)]  # a token in two roles
    assert rows(spans.with_predicates(tokens, preds).filter("is_predicate"), "tok_id") == [(1,)]


def tree(text, sentence=1):
    """A bracketed tree as rows; leaves are words, numbered as they come."""
    out, open_, words, counts = [], [], itertools.count(), {}
    for part in text.replace("(", " ( ").replace(")", " ) ").split():
        if part == ")":
            out[open_.pop()][3] = len(out) - 1
        elif part != "(":
            up = open_[-1] if open_ else None
            nth = counts.get(up, 0)
            counts[up] = nth + 1
            node = len(out)
            if last == "(":
                out.append(["c", sentence, node, node, up, nth, part, None, None])
                open_.append(node)
            else:
                out.append(["c", sentence, node, node, up, nth, "leaf", next(words), part])
        last = part
    return [tuple(r) for r in out]


def test_conditions_by_tree_pattern(spark):
    trees = ["(S (claus (adv If) (np the order) (vp is valid)) (vp send it))", "(S (sub-cl if (np it) (vp fails) (sf-brk ,)) (vp stop))", "(S (claus (adv If) (np a) (sf-brk ,) (vp b)) c)", "(S (claus (adv when) (np d)) (sub-cl the if e))", "(S (claus (adv If) (sub-cl if f g) h))"]
    data = [r for n, t in enumerate(trees, 1) for r in tree(t, n)]
    nodes = spark.createDataFrame(data, "case_id string, sent_id int, node int, last int, parent int, nth int, label string, tok_id int, word string")
    assert rows(spans.condition_tokens(nodes), "sent_id", "tok_id") == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1), (5, 1), (5, 2), (5, 3), (5, 4)]


def test_pointer_jumping(spark):
    parents = [(i, i - 1 if i % 50 else None) for i in range(300)] + [(1000, 999)]
    got = rows(spans.ancestors(spark.createDataFrame(parents, "node int, parent int"), []), "node", "root", "depth")
    assert got == [(i, i - i % 50, i % 50) for i in range(300)] + [(1000, 999, 1)]
    with pytest.raises(ValueError, match="circle"):
        spans.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, parent int"), [], 8)


LABELS = {
    "Check and suggest updates": ("VB CC VB NN", "double-action", None),
    "decide about document": ("VB IN NN", "action", [("object", 1, 3), ("predicate", 0, 1)][1:]),
    "deliver zooclub magazine": ("VB NN NN", "action", [("object", 1, 3), ("predicate", 0, 1)]),
    "data transmission": ("NN NNA", "noun-action", [("object", 0, 1), ("predicate", 1, 2)]),
    "transmission of data": ("NNA IN NN", "noun-action", [("object", 2, 3), ("predicate", 0, 1)]),
    "send the invoice to the customer": ("VB DT NN TO DT NN", "action", [("object", 1, 3), ("predicate", 0, 1)]),
    "set up": ("VB RP", "action", [("predicate", 0, 2)]),
    "ask customer to pay bill": ("VB NN TO VB NN", "action", [("object", 1, 2), ("predicate", 0, 1)]),
    "to of": ("TO IN", None, []),
    "big red empty box": ("JJ JJ JJ NN", "noun-phrase", []),
}


def test_charts_of_sample_labels(spark):
    tags = spark.createDataFrame([(label, at, tag) for label, (line, _, _) in LABELS.items() for at, tag in enumerate(line.split())] + [("data transmission", 1, "NN")], "label string, at int, tag string")
    found = graph.checkpointed(chart.parse(tags, ["label"]))
    lengths = tags.groupBy("label").agg((F.max("at") + 1).alias("n"))
    whole = chart.tops(found, lengths, ["label"])
    assert {r.label: r.top for r in whole.collect()} == {label: top for label, (_, top, _) in LABELS.items()}
    parts = {}
    for r in chart.parts(found, whole, lengths, ["label"]).collect():
        parts.setdefault(r.label, []).append((r.part, r.i, r.j))
    for label, (_, _, expected) in LABELS.items():
        if expected is not None:
            assert sorted(parts.get(label, [])) == expected, label
    assert chart.parse(tags.filter("false"), ["label"]).count() == 0


def test_chart_against_naive_closure(spark):
    """A grammar that is ambiguous and left- and right-recursive, against closing the rules item by item."""
    rules = {"S": [("S", "S"), ("a",), ("x", "S", "y", "S")], "x": [("b",)], "y": [("b",), ("a", "b")]}
    lines = ["a a a", "b a b a", "b a a b a a", "b b", "a"]
    tags = spark.createDataFrame([(n, at, t) for n, line in enumerate(lines) for at, t in enumerate(line.split())], "n int, at int, tag string")
    got = {(r.n, r.symbol, r.i, r.j) for r in chart.parse(tags, ["n"], rules).collect() if "+" not in r.symbol}
    items = {(n, t, at, at + 1) for n, line in enumerate(lines) for at, t in enumerate(line.split())}
    grown = True
    while grown:
        def ends(n, body, i):
            return {i} if not body else {e for m, s, a, j in items if m == n and s == body[0] and a == i for e in ends(n, body[1:], j)}

        new = {(n, s, i, e) for s, bodies in rules.items() for body in bodies for n, line in enumerate(lines) for i in range(len(line.split())) for e in ends(n, body, i)} - items
        grown, items = bool(new), items | new
    assert got == items


def test_best_sequences_against_all(spark):
    rng = random.Random(6)
    tags = "NVJD"
    moves = {(a, b): rng.randint(-4, 0) for a in "^" + tags for b in tags if rng.random() < 0.9}
    lattices = [[[(t, rng.randint(-2, 0)) for t in rng.sample(tags, rng.randint(1, 4))] for _ in range(n)] for n in (1, 2, 5, 6)] + [[[("N", 0)], []], []]
    df = spark.createDataFrame(list(enumerate(lattices)), "n int, l array<array<struct<tag: string, score: bigint>>>")
    for k in (1, 3, 50):
        for r in df.select("n", chart.k_best(F.col("l"), moves, k).alias("best")).collect():
            every = []
            for seq in itertools.product(*lattices[r.n]):
                last, cost = "^", 0
                for tag, score in seq:
                    cost, last = cost - score - moves.get((last, tag), -1_000_000), tag
                every.append((cost, " ".join(t for t, _ in seq)))
            assert [(s.cost, s.path) for s in r.best] == sorted(every)[:k]


def test_ranks_and_senses(spark):
    edges = spark.createDataFrame([("a-n", "c-n"), ("b-n", "c-n"), ("b-n", "d-n"), ("c-n", "d-n"), ("c-n", "d-n"), ("e-v", None)], "child string, parent string")
    ranks = {r.node: r.rank for r in senses.page_rank(edges, 40).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["d-n"] > ranks["c-n"] > ranks["a-n"] == ranks["b-n"]
    assert senses.page_rank(edges.filter("false")).count() == 0
    words = spark.createDataFrame([("a-n", ["dog", "cat"]), ("d-n", ["dog"]), ("b-n", ["cat"]), ("z-v", ["dog"]), ("q-x", ["odd"])], "wn string, senses array<string>")
    best = senses.best_senses(words, senses.page_rank(edges, 40))
    assert rows(best, "lemma", "pos", "wn") == [("cat", "noun", "a-n"), ("dog", "noun", "d-n"), ("dog", "verb", "z-v")]
    tokens = spark.createDataFrame([(0, "dog", "noun", None), (1, "dog", "noun", "own"), (2, "eel", "noun", None)], "tok_id int, lemma string, pos string, wn string")
    assert rows(senses.with_senses(tokens, best), "tok_id", "wn") == [(0, "d-n"), (1, "own"), (2, None)]
    assert rows(senses.ranked_senses(tokens, ["tok_id"], words, senses.page_rank(edges, 40)).filter("tok_id = 0"), "nth", "wn") == [(1, "d-n"), (2, "a-n")]


def test_cache_analyses_what_is_new_only(spark, tmp_path):
    asked = []

    def analyse(texts):
        asked.append(sorted(map(str, (r.text for r in texts.collect()))))
        return texts.select("key", "prefix", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))

    def run(texts, stamp):
        df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "n int, text string, lang string")
        out, n = cache.cached(spark, str(tmp_path / "c"), df, ["text", "lang"], analyse, "word string", stamp)
        return rows(out, "n", "word"), n

    assert run(["a b", "c", "a b", None, ""], 0) == ([(0, "a"), (0, "b"), (1, "c"), (2, "a"), (2, "b"), (3, ""), (4, "")], 4)
    assert run(["c", "d"], 1) == ([(0, "c"), (1, "d")], 1) and asked[-1] == ["d"]
    assert run(["a b", "c", "d", None], 2)[1] == 0 and asked[-1] == []
    batch = cache.keyed(spark.createDataFrame([("c", "en", "new")], "text string, lang string, word string"), "text", "lang")
    again = [cache.add(spark, str(tmp_path / "c"), batch, stamp, "word string") for stamp in (5, 5, 4, 6)]
    assert again == [1, 0, 0, 1] and run(["c"], 7) == ([(0, "new")], 0)  # a later stamp wins, a repeated one adds nothing
    keys = cache.keyed(spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("1:a", "bc")], "x string, y string"), "x", "y")
    assert keys.select("key").distinct().count() == 5


def test_any_number_of_annotators(spark):
    kind = "case_id string, elem_id string, sent_id int, err string"
    one = spark.createDataFrame([("c", "a", 1, None), ("c", "b", 2, None), ("c", "x", None, "m")], kind)
    two = spark.createDataFrame([("c", "a", 1, None), ("c", "b", 3, None)], kind)
    three = spark.createDataFrame([("c", "a", 2, None), ("c", "b", 3, None), ("c", "y", 1, None), ("c", "y", 1, None)], kind)
    got = rows(evaluate.compare_many({"one": one, "two": two, "three": three}), "elem_id", "held", "agree", "answer", "one_sided")
    assert got == [("a", 7, 3, "1", False), ("b", 7, 6, "3", False), ("x", 1, 1, "m", True), ("y", 4, 4, "1", True)]


def test_bypass_says_when_it_ends_early(spark):
    chain = spark.createDataFrame([("c", str(i), str(i + 1)) for i in range(8)], "case_id string, src string, dst string")
    gone = spark.createDataFrame([("c", str(i)) for i in range(1, 8)], "case_id string, node string")
    assert rows(graph.bypass(chain, gone, ["case_id"]), "src", "dst") == [("0", "8")]
    with pytest.raises(RuntimeError, match="do not end"):
        graph.bypass(chain, gone, ["case_id"], most_rounds=3)


def test_alignment_with_tables_of_another_analyser(spark):
    """Predicates, arguments, trees and senses take the place of what tokens say of themselves."""
    models = spark.createDataFrame([("c", BPMN)], "case_id string, xml string")
    tokens = analysis.analyse_texts(spark.createDataFrame([("c", TEXT)], "case_id string, text string"))
    own = {(r.sent_id, r.lemma): r.tok_id for r in tokens.collect()}
    check, clerk, order = own[1, "check"], own[1, "clerk"], own[1, "order"]
    preds = spark.createDataFrame([("c", 1, "p", check)], _P)
    args = spark.createDataFrame([("c", 1, "p", "A0", clerk, clerk, clerk), ("c", 1, "p", "A1", order, order, order), ("c", 1, "p", "A0", order, order, order)], _A)
    nodes = spark.createDataFrame([("c", 2, 0, 2, None, 0, "sub-cl", None, None), ("c", 2, 1, 1, 0, 0, "w", 0, "If"), ("c", 2, 2, 2, 0, 1, "w", own[2, "order"], "order")], "case_id string, sent_id int, node int, last int, parent int, nth int, label string, tok_id int, word string")
    hypernyms = spark.createDataFrame([("order-n", "document-n"), ("document-n", "thing-n"), ("other-n", "thing-n")], "child string, parent string")
    words = spark.createDataFrame([("order-n", ["order"]), ("other-n", ["order"])], "wn string, senses array<string>")
    run = align.align(models, None, Config(), hypernyms=hypernyms, annotated=tokens, predicates=preds, arguments=args, constituents=nodes, word_senses=words)
    found = {(r.sent_id, r.ftype, r.arg.split("\u0001")[0]) for r in run.text_features.collect()}
    assert {(1, "has-action", "check"), (1, "in-agent", "order"), (1, "in-patient", "order"), (1, "agent-head", "clerk"), (2, "lemma-conditional-follow", "order"), (1, "has-parent-synset", "document-n")} <= found
    assert {s for s, f, _ in found if f == "has-action"} == {1} and {a for _, f, a in found if f == "lemma-conditional-follow"} == {"order"}
    assert "has-synset" in {r.ftype for r in run.model_features.collect()}
    assert run.alignment.filter("elem_id = 't1'").first().sent_id == 1
