import math

import pytest
from pyspark.sql import functions as F

from tramline.config import Config
from tramline.functions import nlp
from tramline.functions import text as T
from tramline.operators import analysis, assignment, evaluate, features, graph, predictors, similarity
from tramline.plans import align, optimize
from tramline.sources import readers

BPMN = """<b:definitions xmlns:b="x"><b:collaboration><b:participant id="P" name="Sales department" processRef="p1"/>
<b:participant id="Q" name="Warehouse" processRef="p2"/><b:messageFlow id="m1" sourceRef="t2" targetRef="t3"/><b:messageFlow id="m2" sourceRef="t2" targetRef="t4"/></b:collaboration>
<b:process id="p1"><b:startEvent id="s1"/><b:task id="t1" name="Check the order"/><b:exclusiveGateway id="g1" name="order valid?"/><b:userTask id="t2" name="Send order"/><b:task id="t5" name="Reject the order"/><b:endEvent id="e1"/>
<b:laneSet><b:lane id="L" name="Clerk"><b:flowNodeRef>t1</b:flowNodeRef></b:lane></b:laneSet>
<b:sequenceFlow id="f1" sourceRef="s1" targetRef="t1"/><b:sequenceFlow id="f2" sourceRef="t1" targetRef="g1"/><b:sequenceFlow id="f3" name="valid" sourceRef="g1" targetRef="t2"/><b:sequenceFlow id="f4" sourceRef="g1" targetRef="t5"/><b:sequenceFlow id="f5" sourceRef="t2" targetRef="e1"/><b:sequenceFlow id="f6" sourceRef="t5" targetRef="e1"/><b:subProcess id="x"><b:task id="hidden"/></b:subProcess></b:process>
<b:process id="p2"><b:startEvent id="s2"/><b:task id="t3" name="Pick the goods"/><b:task id="t4" name="Ship goods"/><b:sequenceFlow id="f7" sourceRef="s2" targetRef="t3"/><b:sequenceFlow id="f8" sourceRef="t3" targetRef="t4"/></b:process></b:definitions>"""
TEXT = "First, the clerk checks the order. If the order is valid, the clerk sends it to the warehouse. Otherwise the order is rejected. The warehouse picks the goods.\nThen the goods are shipped."


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tf_idf_sample(spark):
    tokens = spark.createDataFrame([(1, "Dog dog cat dog"), (2, "Cat cat parrot dog")], "sent_id int, t string").select("sent_id", F.explode(T.tokens(F.col("t"))).alias("lemma"))
    tf = features.term_frequency(tokens, ["sent_id"])
    idf = features.inverse_frequency(tf, [], spark.range(1).select(F.lit(2).alias("n_owners")))
    assert rows(tf, "sent_id", "lemma", "tf") == [(1, "cat", 0.25), (1, "dog", 0.75), (2, "cat", 0.5), (2, "dog", 0.25), (2, "parrot", 0.25)]
    assert {r.lemma: r.idf for r in idf.collect()} == pytest.approx({"dog": 0, "cat": 0, "parrot": math.log(2)})
    lone = features.tf_idf(tf, idf.filter("lemma <> 'dog'"), [])
    assert {r.tfidf for r in lone.filter("lemma = 'dog'").collect()} == {0.001}


def test_similarities(spark):
    f = lambda owner, xs: spark.createDataFrame([(o, "f", a, w) for o, a, w in xs], f"{owner} int, ftype string, arg string, weight double")
    text, model = f("sent_id", [(1, "a", 2.0), (1, "b", 1.0)]), f("elem_id", [(7, "a", 4.0), (7, "c", 1.0), (7, "d", 1.0)])
    expected = {"jaccard": 1 / 4, "fake-jaccard": 1 / 2, "raw-weighted-overlapping": 2.0, "weighted-fake-jaccard": 2 / 3, "weighted-jaccard": 2 / (3 + 6 - 2), "cosine": 8 / math.sqrt(5 * 18)}
    for name, value in expected.items():
        assert similarity.similarities(text, model, name, []).first().sim == pytest.approx(value), name
    same = f("elem_id", [(7, "a", 9.0), (7, "c", 1.0)])
    assert similarity.similarities(text, same, "raw-weighted-overlapping", []).first().sim == 2.0  # equal lengths: the text's weights


def test_feature_algebra(spark):
    df = spark.createDataFrame([(1, "f", "a", 1.0), (1, "f", "a", 3.0), (1, "g", "a", 2.0)], "o int, ftype string, arg string, weight double")
    assert rows(features.distinct_features(df, ["o"]), "ftype", "weight") == [("f", 3.0), ("g", 2.0)]
    chain = features.hypernym_chain(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "child string, parent string"), 3)
    assert rows(chain.filter("node = 'a'"), "ancestor", "step") == [("b", 0), ("c", 1), ("d", 2)]
    said = spark.range(1).select(features.explain(F.lit("has-lemma"), F.lit("noun\u0001dog")).alias("x")).first().x
    assert said == 'Contains the noun "dog"'
    tokens = spark.createDataFrame([(1, "if", None), (1, "dog", None)], "sent_id int, lemma string, wn string").withColumn("tfidf", F.lit(1.0))
    assert features.synset_features(tokens, ["sent_id"], None, Config()).count() == 2
    assert features.synset_features(tokens, ["sent_id"], None, Config(null_synset_matches=False)).count() == 0
    assert rows(features.marker_features(tokens, ["sent_id"], Config()), "arg") == [("conditional",)]


def test_graphs(spark):
    e = spark.createDataFrame([(1, "s", "s", "a"), (1, "s", "a", "b"), (1, "s", "b", "a"), (1, "s", "b", "c")], "case_id int, start string, src string, dst string")
    assert rows(graph.back_edges(e, "case_id"), "src", "dst") == [("b", "a")]
    dag = graph.acyclic(e, "case_id")
    assert rows(graph.closure(dag, ["case_id"]), "src", "dst") == [("a", "b"), ("a", "c"), ("b", "c"), ("s", "a"), ("s", "b"), ("s", "c")]
    assert rows(graph.levels(dag, ["case_id"]), "node", "level") == [("a", 1), ("b", 2), ("c", 3), ("s", 0)]
    assert ("a", "a") in rows(graph.closure(e, ["case_id"]), "src", "dst")
    gone = spark.createDataFrame([(1, "a"), (1, "b")], "case_id int, node string")
    assert rows(graph.bypass(dag, gone, ["case_id"]), "src", "dst") == [("s", "c")]
    rel = graph.relations(spark.createDataFrame([(1, x) for x in "sabc"], "case_id int, node string"), graph.closure(e, ["case_id"]), ["case_id"])
    assert {(r.x, r.y): r.rel for r in rel.collect()}[("a", "b")] == "||"
    flows = spark.createDataFrame([(1, 0, "x", "y"), (1, 1, "y", "z"), (1, 2, "z", "w"), (1, 3, "u", "v")], "case_id int, seq int, src string, dst string")
    assert rows(graph.usable_message_flows(flows, ["case_id"]), "seq") == [(0,), (3,)]
    bond = spark.createDataFrame([(1, "s", "s", "g"), (1, "s", "g", "a"), (1, "s", "g", "b"), (1, "s", "a", "h"), (1, "s", "b", "h"), (1, "s", "h", "e")], "case_id int, start string, src string, dst string")
    gates = spark.createDataFrame([(1, "g"), (1, "h")], "case_id int, elem_id string")
    assert rows(graph.sese_pairs(bond, gates, "case_id"), "open", "close") == [("g", "h")]


def test_predictors(spark):
    sims = spark.createDataFrame([(1, 1, 0.6), (2, 1, 0.2), (1, 2, 0.8)], "sent_id int, elem_id int, sim double")
    aligned = predictors.trivial_alignment(sims, [])
    assert rows(aligned, "elem_id", "sent_id", "sim") == [(1, 1, 0.6), (2, 1, 0.8)]
    stats = predictors.statistics(sims, aligned, [], spark.range(1).select(F.lit(2).alias("n_sents"), F.lit(2).alias("n_elems")))
    value = lambda n: {r.elem_id: r.v for r in stats.select("elem_id", predictors.predictor(n).alias("v")).collect()}
    assert value("p-rel-S") == pytest.approx({1: 0.75, 2: 1.0}) and value("p-avg-T") == pytest.approx({1: 1.5, 2: 2.0})
    assert value("S-diff") == pytest.approx({1: 0.2, 2: 0.4}) and value("A-diff") == pytest.approx({1: -0.1, 2: 0.1})
    size = math.hypot(0.6, 0.2)
    assert value("entropy-S")[1] == pytest.approx(-sum(p * math.log(p) for p in (0.6 / size, 0.2 / size)))
    assert rows(predictors.cutoff(stats, "p-rel-S", 0.8).filter("missing"), "elem_id") == [(1,)]
    with pytest.raises(ValueError):
        predictors.predictor("max-constrained")


def test_evaluation(spark):
    truth = spark.createDataFrame([("c", "a", 0, None), ("c", "b", None, "m"), ("c", "d", 3, None)], "case_id string, elem_id string, sent_id int, err string")
    compared = evaluate.compare(truth, truth)
    assert all(r.correct and not r.one_sided for r in compared.collect())
    classes = spark.createDataFrame([("c", "a", "task"), ("c", "b", "task"), ("c", "d", "event")], "case_id string, elem_id string, class string")
    wrong = truth.withColumn("sent_id", F.when(F.col("elem_id") == "a", 5).otherwise(F.col("sent_id")))
    acc = evaluate.accuracy_by_class(evaluate.compare(wrong, truth), classes)
    assert rows(acc, "class", "n_correct", "n_total") == [("all", 2, 3), ("event", 1, 1), ("task", 1, 2)]


def test_readers(spark):
    models = spark.createDataFrame([("c", BPMN), ("broken", "<a"), ("none", None)], "case_id string, xml string")
    parts = readers.bpmn_parts(models)
    t = readers.bpmn_tables(parts)
    assert rows(parts.filter("kind = 'error'"), "case_id") == [("broken",), ("none",)]
    assert "hidden" not in {r.elem_id for r in t["elements"].collect()} and t["elements"].count() == 9
    assert rows(t["message_flows"], "src", "dst") == [("t2", "t3"), ("t2", "t4")] and rows(t["members"], "lane_id", "elem_id") == [("L", "t1")]
    gt = readers.ground_truth(spark.createDataFrame([("c", '{"tasks":["a","b"],"num-sentences":2,"alignment":{"a":1,"b":"no-match"},"errors":null}')], "case_id string, json string"))
    assert rows(gt, "elem_id", "sent_id", "err") == [("a", 1, None), ("b", None, "m")]
    lines = spark.createDataFrame([("1-n 2-n:3-n",), ("2-n -",)], "value string")
    assert rows(readers.hypernyms(lines), "child", "parent") == [("1-n", "2-n"), ("1-n", "3-n")]


def test_labels():
    kinds = {"Check and suggest updates": ("double-action", ["check", "suggest"], "updates"), "decide about document": ("action", ["decide"], "document"), "deliver zooclub magazine": ("action", ["deliver"], "magazine"), "data transmission": ("noun-action", ["transmit"], "data"), "transmission of data": ("noun-action", ["transmit"], "data"), "Warehouse": ("noun-phrase", [], "warehouse")}
    for label, (kind, predicates, head) in kinds.items():
        got = nlp.parse_label(label)
        assert (got.kind, got.predicates, got.object[-1].form) == (kind, predicates, head), label
    assert nlp.parse_label(" .; ").kind == "empty" and nlp.clean_label("\n a b.; ") == "a b"
    tokens = nlp.annotate(nlp.tokenise("If the order is valid, the clerk sends the goods."))
    assert [t.lemma for t in tokens if t.in_condition and t.pos == "noun"] == ["order", "valid"]
    assert {t.form: t.role for t in tokens if t.is_head} == {"clerk": "A0", "goods": "A1"}


def test_anaphoras(spark):
    tokens = analysis.analyse_texts(spark.createDataFrame([("c", "The clerk checks the order. He sends it."), ("n", None)], "case_id string, text string"))
    mentions = spark.createDataFrame([("c", "x", 1, 1, 1), ("c", "x", 2, 2, 0)], "case_id string, entity_id string, seq int, sent_id int, tok_id int")
    out = {(r.sent_id, r.tok_id): (r.form, r.begin) for r in analysis.resolve_anaphoras(tokens, mentions).collect()}
    assert out[(2, 0)] == ("clerk", 0) and out[(1, 1)] == ("clerk", 4)


@pytest.mark.parametrize("config", [Config(), Config.preset(), Config(remove_back_edges=True, disable_restrictions=True, similarity_function="cosine", enable_tf_idf=False), Config(enable_anchors=True, closing_gateway_mode="intended")])
def test_alignment(spark, config):
    models, texts = spark.createDataFrame([("c", BPMN)], "case_id string, xml string"), spark.createDataFrame([("c", TEXT)], "case_id string, text string")
    run = align.align(models, texts, config)
    found = {r.elem_id: r.sent_id for r in run.alignment.collect()}
    assert found["t1"] == 1 and found["t3"] == 4 and found["t4"] in (4, 5)
    before = {(r.src, r.dst) for r in run.order.collect()}
    assert ("t1", "t4") in before and ("t4", "t1") not in before  # over the message flow
    free, bound = (df.agg(F.sum("sim")).first()[0] for df in (run.trivial, run.constrained))
    assert bound <= free + 1e-9 and 0 < run.scores.first().total_score <= 1
    said = align.matches(run, config)
    assert said.count() == len(found) and "Check the order" in align.report(said).first().report
    assert align.evaluate_run(run, evaluate.gt_structure(run.alignment)).filter("class = 'all'").first().accuracy == 1.0


def test_max_constrained_and_correction(spark):
    t = spark.createDataFrame([(1, 1, 2, 0.9), (2, 1, 1, 0.5)], "case_id int, elem_id int, sent_id int, sim double")
    c = spark.createDataFrame([(1, 1, 1, 0.1), (2, 1, 1, 0.5)], "case_id int, elem_id int, sent_id int, sim double")
    loss = assignment.max_constrained(t, c, "case_id")
    assert rows(assignment.correct_order(t, c, loss, 0.5, "case_id"), "case_id", "sent_id") == [(1, 2), (2, 1)]


def test_optimise():
    weights, best, history = optimize.search(lambda ws: [w["has-form"] - w["has-lemma"] for w in ws], generations=15, population=8)
    assert history == sorted(history) and best >= history[-1] and set(weights) == set(optimize.FAMILIES)


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.sentences(F.lit(" A b. C! \n\n d "))) == ["A b.", "C!", "d"]
    assert get(T.lower_capitalised(F.lit("Send SQL Now"))) == "send SQL now" and get(T.base_name(F.lit("/a/b.c.bpmn"))) == "b.c"
    assert get(T.bag_distance(F.lit("aab"), F.lit("abc"))) == 3 and get(T.bag_distance(F.lit(""), F.lit(""))) == 0
    assert get(T.harmonic_mean(F.lit(1.0), F.lit(3.0))) == pytest.approx(1.5) and get(T.harmonic_mean(F.lit(0.0), F.lit(3.0))) is None
