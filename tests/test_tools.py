import json

import pytest
from pyspark.sql import functions as F
from test_operators import BPMN, TEXT, rows

from tramline.config import FEATURE_WEIGHTS, Config
from tramline.operators import evaluate, legacy, similarity
from tramline.plans import align, benchmark
from tramline.sources import history, readers


def test_benchmark(spark, tmp_path):
    for folder, end, body in (("m", "bpmn", BPMN), ("t", "txt", TEXT)):
        (tmp_path / folder).mkdir()
        for case in ("one", "two"):
            (tmp_path / folder / f"{case}.{end}").write_text(body)
    (tmp_path / "t" / "lone.txt").write_text(TEXT)
    models, texts = readers.read_models(spark, str(tmp_path / "m")), readers.read_texts(spark, str(tmp_path / "t"))
    run = align.align(models, texts)
    truth = evaluate.gt_structure(run.alignment)
    results, seconds = benchmark.run_benchmark(models, texts, truth, {"a": Config(), "b": Config(feature_weight_overrides={"has-form": 3.0})})
    assert set(seconds) == {"a", "b"} and rows(results.filter("setting = 'a' and class = 'all'"), "case_id", "accuracy") == [("one", 1.0), ("two", 1.0)]
    table = {r.case_id: r.a for r in benchmark.table(results, ["a", "b"]).collect()}
    assert table["pooled_accuracy"] == 1.0 and set(table) == {"one", "two", "mean_case_accuracy", "pooled_accuracy", "median_accuracy"}
    assert rows(benchmark.unmatched(models, texts, truth), "case_id", "has_model") == [("lone", False)]
    assert rows(readers.complete_cases(models, texts, truth), "case_id") == [("one",), ("two",)]


def test_weighed_sums_equal_similarities_of_weighted_features(spark):
    f = lambda owner, xs: spark.createDataFrame([(1, *x) for x in xs], f"case_id int, {owner} int, ftype string, arg string, weight double")
    text = f("sent_id", [(1, "f", "a", 2.0), (1, "g", "a", 1.0), (2, "f", "b", 0.5), (2, "f", "a", 0.25), (2, "g", "c", 3.0)])
    model = f("elem_id", [(7, "f", "a", 4.0), (7, "g", "c", 1.0), (8, "g", "a", 1.5), (9, "f", "z", 1.0)])
    settings = {"even": {"f": 1.0, "g": 1.0}, "odd": {"f": 3.0, "g": 0.2}, "none": {"f": 0.0, "g": 0.0}}
    sums = similarity.family_sums(text, model, ("f", "g"), ["case_id"])
    for name in similarity.FUNCTIONS:
        got = {(r.setting, r.sent_id, r.elem_id): r.sim for r in similarity.weigh(sums, settings, name, ("f", "g"), ["case_id"]).collect()}
        expected = {}
        for setting, w in settings.items():
            own = lambda df: df.withColumn("weight", F.col("weight") * F.when(F.col("ftype") == "f", w["f"]).otherwise(w["g"]))  # noqa: B023, E731
            expected |= {(setting, r.sent_id, r.elem_id): r.sim for r in similarity.similarities(own(text), own(model), name, ["case_id"]).collect()}
        assert got == pytest.approx(expected), name
    with pytest.raises(ValueError):
        similarity.weigh(sums, {"low": {"f": -1.0, "g": 1.0}}, "cosine", ("f", "g"), ["case_id"])


def test_population(spark):
    """One job over a population gives what an alignment for each set of weights gives."""
    models = spark.createDataFrame([("one", BPMN), ("bad", "<x")], "case_id string, xml string")
    texts = spark.createDataFrame([(c, TEXT) for c in ("one", "bad")], "case_id string, text string")
    weights, config = {"flat": dict.fromkeys(FEATURE_WEIGHTS, 1.0), "own": {}}, Config.preset()
    found = align.align_population(models, texts, weights, config)
    run = align.align(models, texts, config)
    own = found.alignment.filter("setting = 'own'")
    assert rows(own, "case_id", "elem_id", "sent_id") == rows(run.alignment, "case_id", "elem_id", "sent_id") and found.alignment.count() == 2 * own.count()
    near = {(r.case_id, r.sent_id, r.elem_id): r.sim for r in found.similarities.filter("setting = 'own'").collect()}
    assert {(r.case_id, r.sent_id, r.elem_id): r.sim for r in run.similarities.collect()} == pytest.approx(near)
    results = align.evaluate_population(found, evaluate.gt_structure(run.alignment)).filter("class = 'all' and setting = 'own'")
    assert rows(results, "case_id", "accuracy") == [("one", 1.0)] and [r.case_id for r in run.rejected.collect()] == ["bad"]


def test_populations_group_by_all_but_weights():
    groups = benchmark.populations({"a": Config(), "b": Config.preset(), "c": Config(feature_weight_overrides={"has-form": 1.0}), "d": Config(feature_weight_overrides={"has-form": -1.0})})
    assert [sorted(g) for _, g in groups] == [["a", "c"], ["b"], ["d"]]


def test_fitness_is_by_place_in_the_population(spark, monkeypatch):
    scored = spark.createDataFrame([("1", "c", "all", 1, 2, 0.5), ("0", "c", "all", 2, 2, 1.0), ("0", "c", "task", 0, 1, 0.0)], "setting string, case_id string, class string, n_correct int, n_total int, accuracy double")
    asked = []
    monkeypatch.setattr(benchmark, "run_benchmark", lambda m, t, g, settings: (asked.append(settings), (scored, {}))[1])
    assert benchmark.fitness(None, None, None, Config())([{"has-form": 1.0}, {"has-form": 2.0}, {"has-form": 3.0}]) == [1.0, 0.5, 0.0]
    assert [c.weights()["has-form"] for c in asked[0].values()] == [1.0, 2.0, 3.0]


def test_rejected_cases(spark):
    twice = BPMN.replace('<b:startEvent id="s2"/>', '<b:startEvent id="s2"/><b:startEvent id="s3"/>')
    models = spark.createDataFrame([("c", BPMN), ("x", "no xml"), ("y", twice)], "case_id string, xml string")
    texts = spark.createDataFrame([(c, TEXT) for c in "cxy"], "case_id string, text string")
    run = align.align(models, texts)
    assert {r.case_id for r in run.alignment.collect()} == {"c"}
    assert {r.case_id: r.why[:13] for r in run.rejected.collect()} == {"x": "unreadable: s", "y": "process p2 ha"}


def test_legacy(spark):
    names = spark.createDataFrame([("c", "chek order"), ("c", "zzz")], "case_id string, name string")
    known = spark.createDataFrame([("c", 1, "check order"), ("c", 2, "send goods")], "case_id string, id int, label string")
    assert ("c", "chek order", 1) in rows(legacy.closest(names, known), "case_id", "name", "id")
    patches = spark.createDataFrame([("c", "zzz", 9)], "case_id string, name string, id int")
    assert rows(legacy.patched(names, known, patches), "name", "id") == [("chek order", 1), ("zzz", 9)]
    files = spark.createDataFrame([("/a/model1.txt",), ("/a/zoo.txt",)], "path string")
    assert rows(legacy.best_file(files, ["zo"]), "path") == [("/a/zoo.txt",)]
    editor = spark.createDataFrame([("c", '{"1": ["a", "b"], "2": []}')], "case_id string, json string")
    assert rows(legacy.editor_alignment(editor), "sent_id", "elem_id") == [(1, "a"), (1, "b")]
    f = spark.range(1000)
    assert 600 < legacy.drop_features(f, 0.3).count() < 800 and rows(legacy.repeated(spark.createDataFrame([(1,), (1,), (2,)], "x int"), ["x"]), "x", "n") == [(1, 2)]


def test_ground_truth_round_trip(spark):
    truth = spark.createDataFrame([("c", "a", 1, None), ("c", "b", None, "m")], "case_id string, elem_id string, sent_id int, err string")
    out = legacy.export_ground_truth(truth, spark.createDataFrame([("c", 2)], "case_id string, n int"))
    assert json.loads(out.first().json) == {"tasks": ["a", "b"], "num-sentences": 2, "alignment": {"a": "1", "b": "no-match"}, "errors": {"b": "m"}}
    assert rows(readers.ground_truth(out), "elem_id", "sent_id", "err") == [("a", 1, None), ("b", None, "m")]
    assert legacy.agreement(truth, truth).first().said == "2 of 2 agree, 0 differ"
    lines = spark.createDataFrame([("c", 0, "id;task;sentence;error"), ("c", 1, "3; Check ;2;"), ("c", 2, "4;Send;;m")], "case_id string, no int, line string")
    assert rows(readers.legacy_ground_truth(lines), "task_id", "task", "sent_id", "err") == [(3, "Check", 2, None), (4, "Send", None, "m")]


def test_legacy_file(spark):
    """The table ends at the first empty line, tasks and sentences each at their first empty id; originals go by place."""
    file = ["id;task;sentence;error;;sid;said", '1;"Check; order";2;;;0;he checks', "2;Send;x;m;;1;he sends", "3;Pack;1;;;;", ";;;;;9;late", "4;lost;1;;;;", ";; ;;;;", "7;outside;1;;;7;outside", "Original text", "He checks it.", "He sends it.", "More."]
    lines = spark.createDataFrame([("c", i, x) for i, x in enumerate(file)] + [("d", 0, "id;task"), ("d", 1, None), ("e", 3, "id"), ("e", 5, "5;Lone;0"), ("e", 9, ";;;;;")], "case_id string, no int, line string")
    assert rows(readers.legacy_ground_truth(lines), "case_id", "task_id", "task", "sent_id", "err") == [("c", 1, "Check; order", 2, None), ("c", 2, "Send", None, "m"), ("c", 3, "Pack", 1, None), ("e", 5, "Lone", 0, None)]
    assert rows(readers.legacy_sentences(lines), "case_id", "sent_id", "said", "sentence") == [("c", 0, "he checks", "He checks it."), ("c", 1, "he sends", "He sends it.")]


def test_extended_structure(spark):
    kinds = [("t", "Task", None), ("u", "Task", "a"), ("e", "Event", None), ("f", "Event", "b"), ("g", "Gateway", None), ("j", "Gateway", None), ("x", "Other", "c")]
    elements = spark.createDataFrame([("c", *k) for k in kinds], "case_id string, elem_id string, elem_type string, name string")
    edges = spark.createDataFrame([("c", a, b) for a, b in ("tg", "gu", "gf", "uj", "fj", "je")], "case_id string, src string, dst string")
    aligned = spark.createDataFrame([("c", "t", 1), ("c", "f", None), ("c", "j", 2)], "case_id string, elem_id string, sent_id int")
    sentences = spark.createDataFrame([("c", 1), ("c", 2)], "case_id string, sent_id int")
    out = {r.elem_id: (r["class"], r.sent_id, r.err, r.n_sents) for r in evaluate.extended_structure(aligned, elements, edges, sentences).collect()}
    assert out == {"t": ("task", 0, None, 2), "u": ("task", None, None, 2), "f": ("event", None, "m", 2), "g": ("gateway", None, None, 2)}


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(ValueError):
        history.load(spark, path)
    assert [history.save(spark.range(n), path) for n in (1, 2)] == [0, 1]
    (tmp_path / "h" / "claim-000002").touch()  # a writer that failed
    spark.range(9).write.parquet(f"{path}/rows-000002")
    assert history.load(spark, path).count() == 2 and history.load(spark, path, 0).count() == 1 and history.versions(spark, path) == [0, 1]
    assert history.save(spark.range(4), path) == 3 and history.load(spark, path).count() == 4
    with pytest.raises(ValueError):
        history.load(spark, path, 2)


def test_json_processes(spark):
    shape = lambda i, kind, out=(), name=None, kids=(): {"resourceId": i, "stencil": {"id": kind}, "properties": {"name": name}, "outgoing": [{"resourceId": o} for o in out], "childShapes": list(kids)}
    lane = shape("L", "Lane", name="Clerk", kids=[shape("s", "StartNoneEvent", ["f"]), shape("t", "Task", name="Check")])
    doc = json.dumps({"childShapes": [shape("P", "Pool", name="Office", kids=[lane]), shape("f", "SequenceFlow", ["t"])]})
    t = readers.bpmn_tables(readers.json_process_parts(spark.createDataFrame([("c", doc), ("x", "{")], "case_id string, json string")))
    assert rows(t["edges"], "src", "dst") == [("s", "t")] and rows(t["elements"], "elem_id", "elem_type", "process_id") == [("s", "Event", "P"), ("t", "Task", "P")]
    assert rows(t["members"], "lane_id", "elem_id") == [("L", "s"), ("L", "t")] and rows(t["pools"], "name") == [("Office",)]


def test_streaming(spark, tmp_path):
    from tramline.streaming.incremental import align_stream

    spark.createDataFrame([("c", BPMN, TEXT)], "case_id string, xml string, text string").write.parquet(str(tmp_path / "in"))
    cases = spark.readStream.schema("case_id string, xml string, text string").parquet(str(tmp_path / "in"))
    q = align_stream(cases, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
