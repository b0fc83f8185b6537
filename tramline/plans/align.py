"""The whole alignment of many (model, text) cases in one lazy plan, with one optimisation step per case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DUMMY_SENTENCE, DUMMY_SIMILARITY, FEATURE_WEIGHTS, Config
from ..operators import analysis, assignment, evaluate, features, graph, predictors, senses, similarity, spans
from ..sources.readers import bpmn_parts, bpmn_tables

_SE = ["case_id", "sent_id", "elem_id"]


@dataclass
class Run:
    """What an alignment produces; all by case_id."""

    elements: DataFrame
    sentences: DataFrame
    text_features: DataFrame
    model_features: DataFrame
    similarities: DataFrame
    order: DataFrame
    constrained: DataFrame
    trivial: DataFrame
    alignment: DataFrame
    scores: DataFrame
    rejected: DataFrame | None = None  # (case_id, why) of the models that could not be read


@dataclass
class _Prepared:
    """What an alignment needs that does not depend on the weights of features, but for the features' own weights."""

    elements: DataFrame
    sentences: DataFrame
    text_features: DataFrame
    model_features: DataFrame
    order: DataFrame
    closed: DataFrame | None
    rejected: DataFrame


@dataclass
class Population:
    """The alignments of many sets of weights; all by (setting, case_id), elements by case_id."""

    elements: DataFrame
    similarities: DataFrame
    alignment: DataFrame
    scores: DataFrame


def _weighted(tokens: DataFrame, owner: str, config: Config) -> DataFrame:
    """Tokens with their tf-idf within the case and side; stop words count neither in tf nor as terms and weigh 0.001."""
    if not config.enable_tf_idf:
        return tokens.withColumn("tfidf", F.lit(1.0))
    content = features.content_tokens(tokens)
    tf = features.term_frequency(content, ["case_id", owner])
    sizes = tokens.groupBy("case_id").agg(F.countDistinct(owner).alias("n_owners"))
    weights = features.tf_idf(tf, features.inverse_frequency(tf, ["case_id"], sizes), ["case_id"]).select("case_id", owner, "lemma", "tfidf")
    joined = tokens.join(weights, ["case_id", owner, "lemma"], "left")
    return joined.withColumn("tfidf", F.coalesce("tfidf", F.lit(0.001)))


def align(models: DataFrame, texts: DataFrame, config: Config = Config(), **tables) -> Run:
    """models(case_id, xml), texts(case_id, text) -> Run. Cases are partitions of every join and never meet.

    tables, all optional. analyser takes the place of the rule analyser for texts; annotated, tokens that another tool has made
    (see analysis.TOKENS), that of both texts and analyser. mentions (see analysis.resolve_anaphoras) resolve pronouns.
    predicates and arguments (see spans.role_tokens) take the place of the tokens' own roles, constituents (see
    spans.condition_tokens) that of their conditions. word_senses(wn, senses) and hypernyms give words of texts and labels
    the sense that ranks best in the hypernym graph, where they have none.

    A model that is no XML is left out and named in Run.rejected. With model_read_strict, so is one with a process that has not
    exactly one start event and an end; the other cases are aligned all the same.
    """
    p = _prepare(models, texts, config, **tables)
    return _decide(p, similarity.similarities(p.text_features, p.model_features, config.similarity_function, ["case_id"]), config)


def align_population(models: DataFrame, texts: DataFrame, weights: dict[str, dict[str, float]], config: Config = Config(), **tables) -> Population:
    """align for many sets of feature weights (setting -> weight by family; families left out keep config's) in one job.

    Texts and models are analysed once and their features joined once, with families apart; each setting folds its weights over
    the sums, and (setting, case) takes the place of the case from there on. Weights must not be negative.
    """
    if any("\u0001" in name for name in weights):
        raise ValueError("a setting's name has a control character")
    families = tuple(FEATURE_WEIGHTS)
    own = {name: config.but(feature_weight_overrides={**config.feature_weight_overrides, **w}).weights() for name, w in weights.items()}
    p = _prepare(models, texts, config.but(feature_weight_overrides=dict.fromkeys(families, 1.0)), **tables)
    sums = graph.checkpointed(similarity.family_sums(p.text_features, p.model_features, families, ["case_id"]))
    sims = similarity.weigh(sums, own, config.similarity_function, families, ["case_id"]).withColumn("case_id", _joined(F.col("setting"))).drop("setting")
    each = lambda df: df.withColumn("_s", F.explode(F.array(*map(F.lit, weights)))).withColumn("case_id", _joined(F.col("_s"))).drop("_s")
    many = _Prepared(each(p.elements), each(p.sentences), p.text_features, p.model_features, each(p.order), p.closed and each(p.closed), p.rejected)
    run = _decide(many, sims, config)
    return Population(p.elements, *map(_parted, (run.similarities, run.alignment, run.scores)))


def _joined(setting: Column) -> Column:
    return F.concat_ws("\u0001", setting, F.col("case_id"))


def _parted(df: DataFrame) -> DataFrame:
    whole = F.col("case_id")
    return df.select(F.substring_index(whole, "\u0001", 1).alias("setting"), F.expr("substring(case_id, instr(case_id, '\u0001') + 1)").alias("case_id"), *[c for c in df.columns if c != "case_id"])


def _prepare(models: DataFrame, texts: DataFrame, config: Config, hypernyms: DataFrame | None = None, analyser: analysis.Analyser | None = None, mentions: DataFrame | None = None, annotated: DataFrame | None = None, predicates: DataFrame | None = None, arguments: DataFrame | None = None, constituents: DataFrame | None = None, word_senses: DataFrame | None = None) -> _Prepared:
    parts = graph.checkpointed(bpmn_parts(models))
    rejected = _rejected(parts, config)
    bad = rejected.select("case_id")
    t = {name: df.join(bad, "case_id", "left_anti") for name, df in bpmn_tables(parts).items()}
    tokens = annotated if annotated is not None else analysis.analyse_texts(texts, analyser)
    tokens = graph.checkpointed(tokens if mentions is None else analysis.resolve_anaphoras(tokens, mentions))
    sentences = tokens.groupBy("case_id", "sent_id").agg(F.first("sentence").alias("sentence"))
    labels = t["elements"].select("case_id", "elem_id", "elem_type", "name")
    for kind, key, name in (("lanes", "lane_id", "Lane"), ("pools", "pool_id", "Pool"), ("edges", "flow_id", "Flow")):
        labels = labels.unionByName(t[kind].select("case_id", F.col(key).alias("elem_id"), F.lit(name).alias("elem_type"), "name"))
    holders = t["members"].select("case_id", F.col("lane_id").alias("holder_id"), "elem_id")
    in_pool = t["elements"].select("case_id", "process_id", "elem_id").join(t["pools"].select("case_id", "process_id", F.col("pool_id").alias("holder_id")), ["case_id", "process_id"])
    holders = holders.unionByName(in_pool.select("case_id", "holder_id", "elem_id")).distinct()
    label_tokens = analysis.analyse_labels(labels)
    if word_senses is not None and hypernyms is not None:
        best = graph.checkpointed(senses.best_senses(word_senses, senses.page_rank(hypernyms)))
        tokens, label_tokens = senses.with_senses(tokens, best), senses.with_senses(label_tokens, best)
    if constituents is not None:
        tokens = spans.with_conditions(tokens, constituents)
    if predicates is not None:
        tokens = spans.with_predicates(tokens, predicates)
    tables = {**t, "tokens": _weighted(tokens, "sent_id", config), "label_tokens": _weighted(label_tokens, "elem_id", config), "holders": holders}
    if predicates is not None and arguments is not None:
        tables["role_tokens"] = spans.role_tokens(predicates, arguments, tables["tokens"])
    if hypernyms is not None:
        tables["hypernyms"] = features.hypernym_chain(hypernyms, config.hypernym_chain_length)
    text_features = features.extract(features.TEXT_EXTRACTORS, config, tables, ["case_id", "sent_id"])
    model_features = features.extract(features.MODEL_EXTRACTORS, config, tables, ["case_id", "elem_id"])

    elements = graph.checkpointed(_alignable(t, config))
    order = _order(t, config)
    return _Prepared(elements, sentences, text_features, model_features, order, _closed(t, order, config), rejected)


def _decide(p: _Prepared, sims: DataFrame, config: Config) -> Run:
    """From similarities to the alignment and its scores."""
    elements, sentences, order = p.elements, p.sentences, p.order
    dense = graph.checkpointed(similarity.all_pairs(sims, sentences, elements, ["case_id"]))
    constrained = graph.checkpointed(assignment.constrained_alignment(dense, elements, order, "case_id", config.enable_anchors, not config.disable_restrictions, p.closed))
    trivial = graph.checkpointed(assignment.constrained_alignment(dense, elements, order, "case_id", config.enable_anchors, False))
    keep = ["case_id", "elem_id", "sent_id", "sim"]
    chosen = constrained.select(*keep)
    if config.enable_wrong_order_cutoff:
        tasks = elements.filter("elem_type = 'Task'")
        chosen = assignment.correct_order(trivial, constrained, assignment.max_constrained(trivial, constrained, "case_id", tasks), config.max_constrained_threshold, "case_id")
    if config.enable_cutoff:
        chosen = _cut(chosen, dense, elements, sentences, config)
    gone = elements.select("case_id", "elem_id").join(chosen, ["case_id", "elem_id"], "left_anti")  # of texts without a sentence
    chosen = graph.checkpointed(chosen.unionByName(gone.select("case_id", "elem_id", F.lit(None).cast("int").alias("sent_id"), F.lit(0.0).alias("sim"))))
    extra = int(config.enable_anchors)  # the dummy counts as a sentence
    n_sents = sentences.groupBy("case_id").agg((F.count(F.lit(1)) + extra).alias("n"))
    n_elems = elements.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return Run(elements, sentences, p.text_features, p.model_features, dense, order, constrained, trivial, chosen, assignment.total_score(chosen, n_sents, n_elems, "case_id"), p.rejected)


def _rejected(parts: DataFrame, config: Config) -> DataFrame:
    """-> (case_id, why): models that could not be parsed and, if reading is strict, those with an invalid process."""
    broken = parts.filter("kind = 'error'").select("case_id", F.concat(F.lit("unreadable: "), F.coalesce("name", F.lit(""))).alias("why"))
    if config.model_read_strict:
        t = bpmn_tables(parts)
        bad = graph.starts_and_ends(t["elements"], t["edges"], ["case_id", "process_id"]).filter("not valid")
        said = F.format_string("process %s has %d start events and %d ends", F.coalesce("process_id", F.lit("")), "n_starts", "n_ends")
        broken = broken.unionByName(bad.select("case_id", said.alias("why")))
    return graph.checkpointed(broken.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("why")))


def _alignable(t: dict[str, DataFrame], config: Config) -> DataFrame:
    """Tasks; with anchors also named events and gateways with one way in and some out."""
    deg = graph.degrees(t["edges"], ["case_id"]).withColumnRenamed("node", "elem_id")
    e = t["elements"].join(deg, ["case_id", "elem_id"], "left").withColumn("is_gateway", F.col("elem_type") == "Gateway")
    named = (F.col("elem_type") == "Event") & (F.coalesce("name", F.lit("")) != "")
    open_ = F.col("is_gateway") & (F.col("n_in") == 1) & (F.col("n_out") >= 1)
    wanted = F.col("elem_type") == "Task"
    if config.enable_anchors:
        wanted = wanted | named | open_
    return e.filter(F.coalesce(wanted, F.lit(False))).select("case_id", "process_id", "elem_id", "elem_type", "tag", "name", "is_gateway")


def _order(t: dict[str, DataFrame], config: Config) -> DataFrame:
    """Pairs (case_id, src, dst) where src comes before dst and not the other way round."""
    edges = t["edges"].select("case_id", "process_id", "src", "dst")
    if config.remove_back_edges:
        starts = t["elements"].filter("tag = 'startEvent'").groupBy("case_id", "process_id").agg(F.min("elem_id").alias("start"))
        keyed = edges.join(starts, ["case_id", "process_id"]).withColumn("process", F.concat_ws("\u0001", "case_id", "process_id"))
        edges = graph.acyclic(keyed, "process").select("case_id", "process_id", "src", "dst")
    flows = graph.usable_message_flows(t["message_flows"], ["case_id"], t["elements"])
    reach = graph.merge_message_flows(edges, flows, ["case_id"])
    return reach.join(graph.reverse(reach).select("case_id", "src", "dst"), ["case_id", "src", "dst"], "left_anti")


def _closed(t: dict[str, DataFrame], order: DataFrame, config: Config) -> DataFrame | None:
    """(case_id, src, dst): split gateways and what comes after the join that closes them; only in the mode "intended"."""
    if config.closing_gateway_mode == "as_written":
        return None
    starts = t["elements"].filter("tag = 'startEvent'").groupBy("case_id", "process_id").agg(F.min("elem_id").alias("start"))
    edges = t["edges"].select("case_id", "process_id", "src", "dst").join(starts, ["case_id", "process_id"])
    process = F.concat_ws("\u0001", "case_id", "process_id").alias("process")
    gates = t["elements"].filter("elem_type = 'Gateway'").select(process, "elem_id")
    pairs = graph.sese_pairs(edges.select(process, "start", "src", "dst"), gates, "process")
    pairs = pairs.select(F.substring_index("process", "\u0001", 1).alias("case_id"), F.col("open"), F.col("close").alias("src"))
    return pairs.join(order, ["case_id", "src"]).select("case_id", F.col("open").alias("src"), "dst")


def _cut(chosen: DataFrame, dense: DataFrame, elements: DataFrame, sentences: DataFrame, config: Config) -> DataFrame:
    """Elements that the predictor calls missing, and those on the dummy, lose their sentence. Gateways take no part in the statistics."""
    plain = elements.filter(~F.col("is_gateway")).select("case_id", "elem_id")
    sims = dense.join(plain, ["case_id", "elem_id"], "left_semi")
    n_sents = sentences.groupBy("case_id").agg((F.count(F.lit(1)) + int(config.enable_anchors)).alias("n_sents"))
    if config.enable_anchors:
        sims = sims.unionByName(plain.select("case_id", F.lit(DUMMY_SENTENCE).alias("sent_id"), "elem_id", F.lit(DUMMY_SIMILARITY).alias("sim")))
    sizes = n_sents.join(plain.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_elems")), "case_id")
    own = chosen.join(plain, ["case_id", "elem_id"], "left_semi")
    cut = predictors.cutoff(predictors.statistics(sims, own, ["case_id"], sizes), config.missing_predictor_type, config.threshold_missing)
    gates = chosen.join(plain, ["case_id", "elem_id"], "left_anti")
    return cut.select("case_id", "elem_id", "sent_id", "sim").unionByName(gates).withColumn("sent_id", F.when(F.col("sent_id") != DUMMY_SENTENCE, F.col("sent_id")))


def matches(run: Run, config: Config = Config()) -> DataFrame:
    """One row per element: its sentence, score, whether it is good, and the shared features in words, heaviest first."""
    shared = features.intersect_features(run.text_features.withColumnRenamed("weight", "_tw"), run.model_features.withColumnRenamed("weight", "_mw").withColumnRenamed("case_id", "_case"))
    shared = shared.filter("case_id = _case").select("case_id", "sent_id", "elem_id", F.struct((-F.least("_tw", "_mw")).alias("w"), features.explain(F.col("ftype"), F.col("arg"), config).alias("said")).alias("f"))
    said = shared.join(run.alignment.select(*_SE), _SE, "left_semi").groupBy(*_SE).agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["said"]).alias("common_features"))
    out = run.alignment.join(run.elements.select("case_id", "elem_id", "elem_type", "name"), ["case_id", "elem_id"]).join(run.sentences, ["case_id", "sent_id"], "left").join(said, _SE, "left")
    return out.select("case_id", "elem_id", "elem_type", F.col("name").alias("elem_name"), "sent_id", "sentence", F.col("sim").alias("score"), F.col("sent_id").isNotNull().alias("is_good"), F.coalesce("common_features", F.array().cast("array<string>")).alias("common_features"))


def report(found: DataFrame) -> DataFrame:
    """matches -> (case_id, report): a text of a case's matches."""
    line = F.format_string("%s [%s] -> %s (%.4f)", F.coalesce("elem_name", F.lit("")), "elem_id", F.coalesce(F.concat_ws(" ", F.col("sent_id").cast("string"), "sentence"), F.lit("missing")), "score")
    lines = found.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("elem_type", "elem_id", line.alias("line")))).alias("_l"), F.count_if("is_good").alias("_g"), F.count(F.lit(1)).alias("_n"))
    section = lambda kind, title: F.concat_ws("\n", F.lit(f"== {title} =="), F.transform(F.filter("_l", lambda x: x["elem_type"] == kind), lambda x: x["line"]))
    summary = F.format_string("== Matching Summary ==\n%d of %d elements matched", "_g", "_n")
    return lines.select("case_id", F.concat_ws("\n", summary, section("Task", "Tasks"), section("Event", "Events"), section("Gateway", "Gateways")).alias("report"))


def evaluate_run(run: Run, truth: DataFrame) -> DataFrame:
    """-> accuracy by case and class of the elements in the truth."""
    guess = evaluate.gt_structure(run.alignment).join(truth.select("case_id", "elem_id"), ["case_id", "elem_id"], "left_semi")
    classes = run.elements.select("case_id", "elem_id", F.lower("elem_type").alias("class"))
    return evaluate.accuracy_by_class(evaluate.compare(guess, truth), classes)


def evaluate_population(found: Population, truth: DataFrame) -> DataFrame:
    """-> (setting, case_id, class, n_correct, n_total, accuracy) of the elements in the truth, for all settings at once."""
    cases = found.alignment.select("setting", "case_id").distinct()
    own = lambda df: df.join(cases, "case_id").withColumn("case_id", _joined(F.col("setting"))).drop("setting")
    asked = own(truth)
    guess = evaluate.gt_structure(found.alignment.withColumn("case_id", _joined(F.col("setting"))))
    guess = guess.join(asked.select("case_id", "elem_id"), ["case_id", "elem_id"], "left_semi")
    classes = found.elements.select("case_id", "elem_id", F.lower("elem_type").alias("class"))
    return _parted(evaluate.accuracy_by_class(evaluate.compare(guess, asked), own(classes)))
