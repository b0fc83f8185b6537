"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os
import re

import duckdb
import pytest

from tramline.plans import queries


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


def flat(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(str, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, oracle, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.ORACLE_SQL:
        assert flat(got) == flat(oracle.execute(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["feature_intersection", "sim_cosine", "sim_weighted_fake_jaccard", "predictor_p_avg_t", "l2_normalised_similarity"])
def test_no_pair_is_shuffled(spark, data, name):
    """Pairs of documents and items are summed where the documents lie; only one row for a document or term is dealt."""
    frame = queries.QUERIES[name](spark, data)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((sent_id#\d+L?, elem_id|elem_id#\d+L?, sent_id)", plan)
    assert not re.search(r"Exchange hashpartitioning\(arg#", plan)
    assert name != "l2_normalised_similarity" or "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["feature_intersection", "predictor_p_rel", "trivial_alignment", "total_score"])
def test_memory_is_bounded(spark, data, name):
    """No task holds a row for each of its pairs, or sorts them: pairs come out of blocks of texts, and best sentences out of plain maxima."""
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys?=\[(sent_id#\d+L?, elem_id|elem_id#\d+L?, sent_id)", plan)
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("docs, items", [([(None, "the order")], [(1, "the order")]), ([(1, "the order")], []), ([], [(1, "the order")]), ([(1, None)], [(1, None)])])
def test_empty_sides(spark, tmp_path, docs, items):
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("feature_intersection", "sim_cosine", "predictor_p_rel"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == [], name


def test_odd_documents(spark, data, tmp_path):
    """Null, empty and repeated texts and ids, and texts shorter and longer than any item."""
    long = " ".join(f"w{i}" for i in range(400))
    docs = [(1, "The order, the ORDER!"), (1, "goods and goods"), (2, None), (3, ""), (4, " .,; "), (5, "ship the goods to the clerk " + long), (6, "order"), (7, "Ünïcode ORDER"), (None, "order of nobody"), (None, "goods"), (8, "ship goods")]
    items = [(1, "check the order"), (2, "ship the goods to the warehouse"), (3, ""), (4, None), (5, "ünïcode nothing else"), (None, "goods")]
    paths = {"documents": (docs, "doc_id long, text string"), "benchmark": (items, "item_id long, text string")}
    con = duckdb.connect()
    for name, (rows, schema) in paths.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("feature_intersection", "sim_cosine", "sim_jaccard", "sim_weighted_jaccard", "sim_weighted_fake_jaccard", "trivial_alignment", "predictor_p_avg_t", "missing_elements", "total_score"):
        got = flat(queries.QUERIES[name](spark, str(tmp_path)).toPandas())
        assert got == flat(con.execute(queries.ORACLE_SQL[name]).df()), name
        assert got[1], name


@pytest.mark.parametrize("most, block", [(0, 1 << 10), (100, 1 << 16), (200_000, 8 << 20)])
def test_common_and_rare_words(spark, data, oracle, monkeypatch, most, block):
    """Lengths are the same however many words count as common, and by blocks of any size; only the others are dealt, and texts are read and dealt once."""
    from tramline.operators import features

    monkeypatch.setattr(features, "MOST_COMMON", most)
    monkeypatch.setattr(features, "BLOCK", block)
    for name in ("sim_cosine", "sim_weighted_jaccard", "sim_weighted_fake_jaccard"):
        frame = queries.QUERIES[name](spark, data)
        assert "FileScan" not in frame._jdf.queryExecution().executedPlan().toString(), name
        assert flat(frame.toPandas()) == flat(oracle.execute(queries.ORACLE_SQL[name]).df()), name


def test_cells_of_slices():
    import pyarrow as pa

    from tramline.operators import features

    said = ["b a b", "", "c", "é b", "", "a"]
    for at in range(6):
        for n in range(7 - at):
            words, n_tokens, row, word, count = features._cells(pa.array(said).slice(at, n))
            got = sorted((int(r), words[int(w)].as_py(), int(c)) for r, w, c in zip(row, word, count))
            assert got == sorted((r, w, t.split().count(w)) for r, t in enumerate(said[at : at + n]) for w in set(t.split()))
            assert n_tokens.tolist() == [len(t.split()) for t in said[at : at + n]]


def test_block_counts(spark):
    """Words are added up by block before they are rows; a text's common words are summed in place, its others listed."""
    import pyarrow as pa

    from tramline.operators import features

    texts = spark.createDataFrame([(1, "a b A"), (2, None), (3, "b, c; d"), (2, "B  é"), (4, "...")], "id long, text string").coalesce(1)
    lists = features.term_lists(texts, "id")
    assert dict(lists.collect()) == {1: "a b a", 2: "b é", 3: "b c d", 4: ""}
    blocks = features.block_frequency(lists.coalesce(1))
    assert sorted(blocks.collect()) == [("a", 1), ("b", 3), ("c", 1), ("d", 1), ("é", 1)]
    idf = blocks.selectExpr("lemma", "df", "1D / df AS idf")
    common, rare = features.common_terms(idf, 4)  # of the four rarest none, as they aren't told apart
    assert common.to_pylist() == [{"lemma": "b", "idf": 1 / 3}]
    assert sorted(r.lemma for r in rare.collect()) == ["a", "c", "d", "é"]
    found = {r.id: r for r in features.known_counts(lists, "id", ["c", "a"], pa.table({"lemma": ["a", "b"], "idf": [1.0, 3.0]}), 2).collect()}
    assert (found[1].n_tokens, found[1].n_terms, found[1].terms, found[1].counts, found[1].rare) == (3, 2, [1], [2], [])
    assert found[1].w == pytest.approx(2 / 3 + 1) and found[1].sq == pytest.approx(4 / 9 + 1)
    assert (found[2].rare, found[2].rare_counts, found[2].w) == (["é"], [1], 1.5)
    assert (found[3].n_terms, found[3].terms, found[3].w, found[3].rare) == (3, [0], None, [])
    assert (found[4].n_tokens, found[4].n_terms, found[4].terms, found[4].w) == (0, 0, [], 0)


@pytest.mark.parametrize("name", ["cutoff_sweep", "gt_structure", "total_score", "trivial_alignment", "missing_elements", "l2_normalised_similarity"])
def test_no_pair_is_written(spark, data, oracle, monkeypatch, name):
    """Pairs grow with documents times items; what is written out grows with each of them, as pairs are folded where they are made."""
    rows = []
    monkeypatch.setattr(queries.graph, "checkpointed", lambda df, f=queries.graph.checkpointed: (out := f(df), rows.append((set(df.columns), out.count())))[0])
    got = queries.QUERIES[name](spark, data).toPandas()
    assert flat(got) == flat(oracle.execute(queries.ORACLE_SQL[name]).df())
    pairs = oracle.execute(f"{queries._PAIRS} SELECT count(*) FROM pairs").fetchone()[0]
    assert rows and not [n for columns, n in rows if {"elem_id", "sent_id"} <= columns and n > pairs / 4]


@pytest.mark.parametrize("kept", [0, 5, 1 << 18])
def test_folds(spark, monkeypatch, kept):
    """Statistics and best sentences are those of all pairs, with ties, the dummy, negative and zero similarities, however few rows a task keeps."""
    import numpy as np
    from pyspark.sql import functions as F

    from tramline.operators import features, predictors, similarity

    monkeypatch.setattr(similarity, "KEPT", kept)
    said = [(i, " ".join("abcdefgh"[(i * k) % 8] for k in range(1, 1 + i % 6))) for i in range(-1, 40)]
    items = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "c", -1.0), (3, "d", 0.0), (4, "none", 1.0), (5, "h", 3.0), (5, "a", 0.5)], "elem_id int, arg string, weight double").withColumn("ftype", F.lit("f"))
    few = similarity.Few(items)
    scale = np.array([{"c": -1.0, "d": 0.0}.get(w, 1.0) for w in few.vocabulary])
    texts = features.known_counts(spark.createDataFrame(said, "sent_id long, said string").repartition(3), "sent_id", few.vocabulary).withColumns({"t_w": F.lit(2.0), "t_l2": F.lit(1.5)})
    sizes = spark.range(1).select(F.lit(40).alias("n_sents"), F.lit(5).alias("n_elems"))
    for name in similarity.FUNCTIONS:
        sims = similarity.weighed(similarity.local_pair_sums(texts, few, scale, similarity.USES[name]), name, ["sent_id", "elem_id"])
        direct = {(r.sent_id, r.elem_id): r.sim for r in similarity.local_similarities(texts, few, scale, name).collect()}
        assert direct == {(r.sent_id, r.elem_id): r.sim for r in sims.collect()}, name
        parts = similarity.local_statistics(texts, few, scale, name, -1, 9)
        sizes_of = dict(parts.filter("t_sq is not null").groupBy("elem_id").agg(F.sqrt(F.sum("t_sq"))).collect())
        scaled = {(r.sent_id, r.elem_id): r.sim for r in similarity.local_similarities(texts, few, scale, name, lengths=sizes_of).collect()}
        wanted = {(r.sent_id, r.elem_id): r.sim for r in similarity.l2_normalised(sims, []).collect()}
        assert scaled == {k: v if v is None else pytest.approx(v, rel=1e-12) for k, v in wanted.items()}, name
        best = predictors.trivial_alignment(parts.filter("sim is not null"), [], digits=9, few=True)
        whole = predictors.trivial_alignment(sims, [], digits=9)
        assert sorted(best.collect()) == sorted(whole.collect()), name
        got = predictors.folded(parts, similarity.local_sentence_statistics(texts, few, scale, name), best, sizes).toPandas()
        want = predictors.statistics(sims, whole, [], sizes).toPandas()[list(got.columns)]
        assert len(got) == 4
        np.testing.assert_allclose(*(x.sort_values("elem_id").to_numpy(float) for x in (got, want)), rtol=1e-12, atol=1e-12, err_msg=name)


def test_blocks_and_rounding():
    import numpy as np
    import pyarrow as pa

    from tramline.operators import similarity

    few = similarity.Few.__new__(similarity.Few)
    few.elems, few.first, few.number, few.weight = pa.array([7, 8, 9]), np.array([0, 2, 3, 3, 6]), np.array([0, 2, 1, 0, 1, 2]), np.arange(1.0, 7)
    few.sides, few.longest = {"m_n": np.array([2, 2, 2])}, 2
    lists = [[0, 3], [], [2], [1], [0, 1, 2, 3], []]
    texts = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([4] * 6, pa.int32()), pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], ["sent_id", "n_tokens", "n_terms", "terms", "counts"])
    for part in (texts, texts.slice(1), texts.slice(3, 2)):
        whole = next(similarity._blocks([part], few, np.ones(4)))
        for cells, shared in ((1, 1), (6, 100), (100, 4), (9, 5)):
            blocks = list(similarity._blocks([part], few, np.ones(4), cells, shared))
            assert max(len(b.texts) for b in blocks) <= max(1, cells // 3)
            for c in ("n_i", "w_i", "w_min", "dot"):
                assert np.array_equal(np.concatenate([b[c] for b in blocks]), whole[c]), c
    assert similarity.rounded(np.array([0.5, -0.5, 1.5, 0.49999999999999994, 2.4, 0.0]), 0).tolist() == [1, -1, 2, 0, 2, 0]
    assert similarity.rounded(np.array([0.1234565, 1 / 3, 2 / 3]), 6).tolist() == [0.123457, 0.333333, 0.666667]


def _shuffled(spark):
    """Records written to shuffles by the session so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_document_words_stay(spark, data, oracle):
    """A row for each document and word is the result; such rows are made where documents lie and not dealt."""
    before = _shuffled(spark)
    got = queries.QUERIES["text_form_features"](spark, data).toPandas()
    dealt = sum(n for stage, n in _shuffled(spark).items() if stage not in before)
    words = oracle.execute(f"WITH {queries._T} SELECT count(*) FROM t_idf").fetchone()[0]
    assert len(got) > 2 * words
    assert dealt < 2 * words + len(got) / 4  # words are dealt for df and perhaps once more for the join


@pytest.mark.parametrize("most, block, repeated", [(0, 1 << 10, 0), (3, 1 << 16, 1), (200_000, 8 << 20, 200_000)])
def test_odd_document_words(spark, tmp_path, monkeypatch, most, block, repeated):
    """Null, empty and repeated texts and ids, however many words count as common, and by blocks of any size."""
    from tramline.operators import features

    for name, value in (("MOST_COMMON", most), ("BLOCK", block), ("MOST_REPEATED", repeated)):
        monkeypatch.setattr(features, name, value)
    docs = [(1, "The order, the ORDER!"), (1, "goods and goods"), (2, None), (3, ""), (4, " .,; "), (5, "ship the goods"), (6, "order"), (7, "Ünïcode ORDER 12³"), (8, None), (8, "the\u0000end the"), (9, "ship goods")]
    nobody = [(None, "order of nobody"), (None, "goods"), (None, None), (None, "nobody")]
    for at, rows in enumerate((docs + nobody, docs, [d for d in docs if d[0] not in (1, 8)], docs[2:5])):
        path = f"{tmp_path}/{at}"
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        got = sorted(map(str, map(tuple, queries.QUERIES["text_form_features"](spark, path).collect())))
        assert got == sorted(map(str, con.execute(queries.ORACLE_SQL["text_form_features"]).fetchall()))
        assert bool(got) == (at < 3)
