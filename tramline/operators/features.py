"""TF-IDF, feature vectors and their algebra.

A feature row is (owner columns..., ftype string, arg string, weight double); arg joins the feature's arguments by \\u0001.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MISSING_WEIGHT, STOP_POS, Config
from ..functions import text as T
from ..llm.common import sliced

#: Discourse markers by type; underscores join the words of a marker.
MARKERS = {
    "conditional": ["if", "whether", "in_case_of", "in_the_case_of", "in_case", "for_the_case", "whereas", "otherwise", "optionally", "depend", "or", "alternative"],
    "parallel": ["while", "meanwhile", "in_parallel", "simultaneously", "concurrently", "meantime", "in_the_meantime"],
    "sequential": ["then", "after", "afterward", "afterwards", "subsequently", "based_on_this", "thus"],
}
#: How a feature is put into words; %1$s and %2$s are its arguments.
EXPLANATIONS = {
    "has-form": 'Contains the lemma "%1$s"',
    "has-lemma": 'Contains the %1$s "%2$s"',
    "has-action": 'Contains the action "%1$s"',
    "agent-head": 'The agent main word is "%1$s" (%2$s)',
    "patient-head": 'The direct object main word is "%1$s" (%2$s)',
    "in-agent": 'The agent contains the %2$s "%1$s"',
    "in-patient": 'The object contains the %2$s "%1$s"',
    "has-synset": "Contains the synset %1$s",
    "has-parent-synset": "Contains an hyponym of %1$s",
    "lemma-conditional-pred": 'Precedes a conditional clause containing the %2$s "%1$s"',
    "lemma-conditional-follow": 'Goes after a conditional clause containing the %2$s "%1$s"',
    "has-discourse-marker": "Contains a %1$s discourse marker",
}


def content_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter(~F.coalesce(F.col("pos"), F.lit("")).isin(*STOP_POS))


def term_frequency(tokens: DataFrame, owner: list[str], lemma: str = "lemma") -> DataFrame:
    """-> (owner, lemma, n, tf): occurrences over the owner's tokens. Two combined aggregations and a join by owner."""
    n = tokens.groupBy(*owner, lemma).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(*owner)
    return n.withColumn("tf", F.col("n") / F.sum("n").over(total))


def inverse_frequency(tf: DataFrame, case: list[str], sizes: DataFrame, lemma: str = "lemma") -> DataFrame:
    """-> (case, lemma, df, idf = ln(N / df)). tf has a row per owner and lemma; sizes is (case, n_owners), or one row without a case."""
    return weighed_frequency(tf.groupBy(*case, lemma).agg(F.count(F.lit(1)).alias("df")), case, sizes, lemma)


def weighed_frequency(df: DataFrame, case: list[str], sizes: DataFrame, lemma: str = "lemma") -> DataFrame:
    """(case, lemma, df) -> the same with idf."""
    joined = df.join(sizes, case) if case else df.crossJoin(F.broadcast(sizes))  # one row
    return joined.select(*case, lemma, "df", F.log(F.col("n_owners") / F.col("df")).alias("idf"))


def tf_idf(tf: DataFrame, idf: DataFrame, case: list[str], lemma: str = "lemma") -> DataFrame:
    """-> tf's rows with idf and tfidf; a missing tf or idf gives the weight 0.001, an idf of 0 gives 0."""
    return with_tf_idf(tf.join(idf, [*case, lemma], "left"))


def with_tf_idf(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tfidf", F.coalesce(F.col("tf") * F.col("idf"), F.lit(MISSING_WEIGHT)))


def term_lists(texts: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """(owner, text) -> (owner, said), one row per owner: its tokens, joined by spaces.

    Texts are dealt by owner once, before words are told apart: what is grouped by owner afterwards is not shuffled again. The
    session's number of parts holds whatever their bytes, as each text makes many more rows.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = texts.select(owner, F.nullif(T.joined_tokens(F.col(text)), F.lit("")).alias("_text")).repartition(parts, owner)
    return said.groupBy(owner).agg(F.concat_ws(" ", F.collect_list("_text")).alias("said"))


#: Owners with several texts whose ids every task is given (a few MB); of more, all texts are dealt by owner.
MOST_REPEATED = 200_000


def placed_lists(texts: DataFrame, repeated: DataFrame, owner: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of term_lists in two parts: of owners with one text, where it lies, and of the few repeated ones (owner), dealt. No owner is null."""
    few = F.broadcast(repeated)
    alone = texts.join(few, owner, "left_anti").select(owner, F.coalesce(T.joined_tokens(F.col(text)), F.lit("")).alias("said"))
    return alone, term_lists(texts.join(few, owner, "left_semi"), owner, text)


#: Bytes of texts whose words are counted at once; a worker holds some ten times as much.
BLOCK = 8 << 20
#: Words whose idf every task is given (a few MB): the most frequent ones, whatever the data. They are nine of ten (text, term) pairs.
MOST_COMMON = 200_000


def _cells(said: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of term_lists -> their different words, each row's number of tokens, and by (row, word), rising: row, place of the word, how often."""
    lists, some = pc.split_pattern(said, " "), pc.not_equal(said, "").to_numpy(zero_copy_only=False)
    words, n_tokens = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    coded = (words if some.all() else words.filter(pa.array(np.repeat(some, n_tokens)))).dictionary_encode()
    n_tokens = n_tokens * some
    size = max(1, len(coded.dictionary))
    cells, n = np.unique(np.repeat(np.arange(len(lists)), n_tokens) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, n_tokens, cells // size, cells % size, n


def _places(words: pa.Array, among: Sequence[str] | pa.Array) -> np.ndarray:
    """Where each word is among others; -1 for none."""
    values = among.cast(words.type) if isinstance(among, pa.Array) else pa.array(among, words.type)
    return pc.fill_null(pc.index_in(words, value_set=values), -1).to_numpy(zero_copy_only=False)


def block_frequency(lists: DataFrame) -> DataFrame:
    """term_lists -> (lemma, df), to be added up by lemma: words are counted in blocks of texts, which makes far fewer rows than one for each (owner, term)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            words, _, _, word, _ = _cells(batch.column("said"))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(word, minlength=len(words)), pa.int64())], ["lemma", "df"])

    return lists.select("said").mapInArrow(counted, "lemma string, df long")


def common_terms(idf: DataFrame, most: int) -> tuple[pa.Table, DataFrame]:
    """(lemma, df, idf) -> the most frequent terms, `most` of them at the most, on the driver, and all others. Parted at a df, found from a count by eighths of its doublings."""
    level = F.floor(F.log2("df") * 8)
    n, least = 0, None
    for step in idf.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        n += step["n"]
        if n > most:
            break
        least = step["level"]
    often = F.lit(False) if least is None else level >= least
    return idf.filter(often).select("lemma", "idf").toArrow().combine_chunks(), idf.filter(~often)


def known_counts(lists: DataFrame, owner: str, vocabulary: Sequence[str], common: pa.Table | None = None, longest: int | None = None) -> DataFrame:
    """term_lists -> (owner, n_tokens, n_terms, terms, counts): the places in a small vocabulary of the words that a row has, rising, and how often.

    A row is counted where it lies, a few MB at a time, so neither the number of rows nor of parts matters to memory. common
    (lemma, idf): also w and sq, the sums of tf * idf and of its squares over the row's words among these, and rare and rare_counts, its
    other words and how often; null and empty for rows of more than `longest` different words. See with_lengths.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in sliced(batches, BLOCK):
            words, n_tokens, row, word, n = _cells(batch.column("said"))
            n_terms = np.bincount(row, minlength=len(n_tokens))
            term = _places(words, vocabulary)[word]
            here = term >= 0
            cell = row[here] * size + term[here]
            order = np.argsort(cell)
            out = [batch.column(owner), pa.array(n_tokens, pa.int32()), pa.array(n_terms, pa.int32())]
            out += _lists(cell[order] // size, len(n_tokens), pa.array(cell[order] % size, pa.int32()), pa.array(n[here][order], pa.int32()))
            if common is not None:
                short = n_terms <= (n_terms if longest is None else longest)
                place = _places(words, common["lemma"].combine_chunks())[word]
                weight = n / n_tokens[row] * np.append(common["idf"].to_numpy(), 0.0)[place]
                out += [pa.array(np.bincount(row, x, len(n_tokens)).astype(float), mask=~short) for x in (weight, weight * weight)]
                rare = short[row] & (place < 0)
                out += _lists(row[rare], len(n_tokens), words.take(pa.array(word[rare])), pa.array(n[rare], pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names)

    columns = f"{owner} {lists.schema[owner].dataType.simpleString()}, n_tokens int, n_terms int, terms array<int>, counts array<int>"
    columns += "" if common is None else ", w double, sq double, rare array<string>, rare_counts array<int>"
    names = [c.split()[0] for c in columns.split(", ")]
    return lists.select(owner, "said").mapInArrow(counted, columns)


def term_rows(lists: DataFrame, owner: str, common: pa.Table, often: bool) -> DataFrame:
    """term_lists -> (owner, lemma, tf, idf), a row for each word of an owner that is among the common ones (lemma, idf); or, not often, (owner, lemma, tf) of each other.

    Rows come out where texts lie, a few MB of these at a time. The other words still need their idf, so they alone are dealt by term.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = common["lemma"].combine_chunks(), common["idf"].combine_chunks()
        for batch in sliced(batches, BLOCK):
            words, n_tokens, row, word, n = _cells(batch.column("said"))
            place = _places(words, known)
            here = (place >= 0)[word] == often
            row, word, n = row[here], word[here], n[here]
            out = [batch.column(owner).take(pa.array(row)), words.take(pa.array(word)), pa.array(n / n_tokens[row])]
            yield pa.RecordBatch.from_arrays([*out, idf.take(pa.array(place[word]))] if often else out, names)

    columns = f"{owner} {lists.schema[owner].dataType.simpleString()}, lemma string, tf double" + (", idf double" if often else "")
    names = [c.split()[0] for c in columns.split(", ")]
    return lists.select(owner, "said").mapInArrow(counted, columns)


def _lists(row: np.ndarray, n_rows: int, *values: pa.Array) -> list[pa.ListArray]:
    """Values of rising rows as lists, one a row."""
    ends = pa.array(np.searchsorted(row, np.arange(n_rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, v) for v in values]


def with_lengths(counted: DataFrame, owner: str, idf: DataFrame, factor: float) -> DataFrame:
    """known_counts with common terms -> the same with t_w and t_l2 over all of a row's words, each tf * idf * factor. idf: of the other terms.

    Only those others, about a tenth of all (owner, term) pairs, are dealt by term.
    """
    seldom = counted.select(owner, "n_tokens", F.explode(F.arrays_zip("rare", "rare_counts")).alias("_r"))
    weight = F.col("_r.rare_counts") / F.col("n_tokens") * F.col("idf")
    met = seldom.withColumn("lemma", F.col("_r.rare")).join(idf.select("lemma", "idf"), "lemma").select(owner, weight.alias("_x"))
    sums = met.groupBy(owner).agg(F.sum("_x").alias("_w"), F.sum(F.col("_x") * F.col("_x")).alias("_sq"))
    both = counted.drop("rare", "rare_counts").join(sums.hint("shuffle_hash"), owner, "left")
    w, sq = (F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)) for c in ("w", "sq"))
    return both.select("*", (w * factor).alias("t_w"), (F.sqrt(sq) * factor).alias("t_l2")).drop("w", "sq", "_w", "_sq")


def argument(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(p, F.lit("\u0000")) for p in parts])


def feature(df: DataFrame, owner: list[str], family: str, args: list[Column], config: Config, multiplier: Column | None = None) -> DataFrame:
    """Rows -> features of a family, weighted by the family's weight times the multiplier (1 where TF-IDF is off)."""
    times = F.lit(1.0) if multiplier is None else multiplier
    return df.select(*owner, F.lit(family).alias("ftype"), argument(*args).alias("arg"), (F.lit(config.weights()[family]) * times).alias("weight"))


def distinct_features(features: DataFrame, owner: list[str]) -> DataFrame:
    """One row per owner, family and argument, with the greatest weight."""
    return features.groupBy(*owner, "ftype", "arg").agg(F.max("weight").alias("weight"))


def union_features(a: DataFrame, b: DataFrame, owner: list[str]) -> DataFrame:
    return distinct_features(a.unionByName(b), owner)


def intersect_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sent_id..., elem_id...) features that both have, with the shorter vector's weight; ties take a's (the text's)."""
    return a.join(b, ["ftype", "arg"])


def marker_features(tokens: DataFrame, owner: list[str], config: Config) -> DataFrame:
    """One feature per marker type with any marker among an owner's lemmas, stop words included; the list is 24 literals.

    Markers of several words are met by lemmas in a row, where tokens have a place (tok_id), or by a lemma that joins them itself.
    """
    longest = max(m.count("_") for k in MARKERS for m in MARKERS[k]) + 1 if "tok_id" in tokens.columns else 1
    w = Window.partitionBy(*owner).orderBy("tok_id")
    heads = F.array(F.col("lemma"), *[F.concat_ws("_", "lemma", *[F.lead("lemma", i).over(w) for i in range(1, n)]) for n in range(2, longest + 1)])
    words = tokens.select(*owner, heads.alias("_heads"))
    kinds = F.filter(F.array(*[F.when(F.arrays_overlap("_heads", F.array(*map(F.lit, MARKERS[k]))), F.lit(k)) for k in MARKERS]), lambda k: k.isNotNull())
    marked = words.select(*owner, F.explode(kinds).alias("marker")).distinct()
    return feature(marked, owner, "has-discourse-marker", [F.col("marker")], config)


def hypernym_chain(parents: DataFrame, length: int) -> DataFrame:
    """(child, parent) -> (node, ancestor, step from 0), up to `length` steps, with one join a step."""
    chain = parents.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(0).alias("step"))
    out = [chain]
    for n in range(1, length):
        up = parents.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
        chain = chain.join(up, "ancestor").select("node", F.col("_next").alias("ancestor"), F.lit(n).alias("step"))
        out.append(chain)
    return reduce(DataFrame.union, out).groupBy("node", "ancestor").agg(F.min("step").alias("step"))


def synset_features(tokens: DataFrame, owner: list[str], chain: DataFrame | None, config: Config) -> DataFrame:
    """has-synset for each token's sense and has-parent-synset, halved each step, for the hypernyms. tokens have wn and tfidf.

    A token without a sense has the null sense, which matches itself, unless null_synset_matches is off.
    """
    known = tokens if config.null_synset_matches else tokens.filter("wn is not null")
    own = feature(known, owner, "has-synset", [F.col("wn")], config, F.col("tfidf"))
    if chain is None:
        return own
    up = tokens.join(chain.filter(F.col("step") < config.hypernym_chain_length), tokens["wn"] == chain["node"])
    decay = F.col("tfidf") * F.pow(F.lit(config.hypernym_multiplier), F.col("step"))
    return own.unionByName(feature(up, owner, "has-parent-synset", [F.col("ancestor")], config, decay))


#: Extractors by side: name -> (config, tables) -> features. Tables are a dict of DataFrames; see plans.align.
Extractor = Callable[[Config, dict[str, DataFrame]], DataFrame]
TEXT_EXTRACTORS: dict[str, Extractor] = {}
MODEL_EXTRACTORS: dict[str, Extractor] = {}


def text_extractor(f: Extractor) -> Extractor:
    TEXT_EXTRACTORS[f.__name__] = f
    return f


def model_extractor(f: Extractor) -> Extractor:
    MODEL_EXTRACTORS[f.__name__] = f
    return f


_S, _E = ["case_id", "sent_id"], ["case_id", "elem_id"]


def _times(config: Config) -> Column:
    return F.col("tfidf") if config.enable_tf_idf else F.lit(1.0)


@text_extractor
def forms(config, t):
    return feature(content_tokens(t["tokens"]), _S, "has-form", [F.col("lemma")], config, _times(config))


@text_extractor
def lemmas(config, t):
    return feature(content_tokens(t["tokens"]), _S, "has-lemma", [F.col("pos"), F.col("lemma")], config, _times(config))


@text_extractor
def synsets(config, t):
    return synset_features(content_tokens(t["tokens"]), _S, t.get("hypernyms"), config)


@text_extractor
def conditionals(config, t):
    return feature(content_tokens(t["tokens"]).filter("in_condition"), _S, "lemma-conditional-follow", [F.col("lemma"), F.col("pos")], config)


@text_extractor
def actions(config, t):
    return feature(t["tokens"].filter("is_predicate"), _S, "has-action", [F.col("lemma")], config)


def _role(config, tokens, owner, role, who):
    head = feature(tokens.filter(F.col("role") == role).filter("is_head"), owner, f"{who}-head", [F.col("lemma"), F.col("pos")], config, _times(config))
    words = content_tokens(tokens).filter(F.col("role") == role)
    words = words.filter("in_role") if "in_role" in tokens.columns else words
    return head.unionByName(feature(words, owner, f"in-{who}", [F.col("lemma"), F.col("pos")], config, _times(config)))


@text_extractor
def agents(config, t):
    return _role(config, t.get("role_tokens", t["tokens"]), _S, "A0", "agent")


@text_extractor
def patients(config, t):
    return _role(config, t.get("role_tokens", t["tokens"]), _S, "A1", "patient")


@text_extractor
def discourse_markers(config, t):
    return marker_features(t["tokens"], _S, config)


def _of(t, *types):
    """Label tokens of elements of some types."""
    return t["label_tokens"].filter(F.col("elem_type").isin(*types))


@model_extractor
def label_forms(config, t):
    return feature(content_tokens(_of(t, "Task", "Event")), _E, "has-form", [F.col("lemma")], config, _times(config))


@model_extractor
def label_lemmas(config, t):
    return feature(content_tokens(_of(t, "Task", "Event", "Gateway")), _E, "has-lemma", [F.col("pos"), F.col("lemma")], config, _times(config))


@model_extractor
def label_synsets(config, t):
    return synset_features(content_tokens(_of(t, "Task", "Event")), _E, t.get("hypernyms"), config)


@model_extractor
def gateway_markers(config, t):
    kind = F.when(F.col("tag") == "exclusiveGateway", "conditional").when(F.col("tag") == "parallelGateway", "parallel")
    return feature(t["elements"].select(*_E, kind.alias("marker")).filter("marker is not null"), _E, "has-discourse-marker", [F.col("marker")], config)


@model_extractor
def label_actions(config, t):
    return feature(_of(t, "Task", "Event").filter("is_predicate"), _E, "has-action", [F.col("lemma")], config, _times(config))


@model_extractor
def branch_lemmas(config, t):
    """Lemmas of the labels on a gateway's outgoing flows."""
    out = t["edges"].select("case_id", F.col("src").alias("elem_id"), F.col("flow_id")).join(t["elements"].filter("elem_type = 'Gateway'").select(*_E), _E)
    words = content_tokens(t["label_tokens"].filter("elem_type = 'Flow'")).select("case_id", F.col("elem_id").alias("flow_id"), "lemma", "pos", "tfidf")
    return feature(out.join(words, ["case_id", "flow_id"]), _E, "has-lemma", [F.col("pos"), F.col("lemma")], config, _times(config))


@model_extractor
def performers(config, t):
    """Agents from the labels of an element's lane and pool: all content words, the last one as head."""
    words = content_tokens(t["label_tokens"].filter("elem_type in ('Lane', 'Pool')")).select("case_id", F.col("elem_id").alias("holder_id"), "tok_id", "lemma", "pos", "tfidf")
    last = Window.partitionBy("case_id", "holder_id")
    words = words.withColumn("role", F.lit("A0")).withColumn("is_head", F.col("tok_id") == F.max("tok_id").over(last))
    who = t["holders"].join(t["elements"].filter("elem_type in ('Task', 'Event')").select(*_E), _E)
    return _role(config, who.join(words, ["case_id", "holder_id"]), _E, "A0", "agent")


@model_extractor
def label_patients(config, t):
    return _role(config, _of(t, "Task", "Event"), _E, "A1", "patient")


@model_extractor
def gateway_context(config, t):
    """Lemmas of named gateways right before (-follow) and right after (-pred) a task or event."""
    words = content_tokens(_of(t, "Gateway")).select("case_id", F.col("elem_id").alias("gate"), "lemma", "pos")
    own = t["elements"].filter("elem_type in ('Task', 'Event')").select(*_E)

    def side(near: str, far: str, family: str) -> DataFrame:
        edges = t["edges"].select("case_id", F.col(near).alias("elem_id"), F.col(far).alias("gate")).join(own, _E)
        return feature(edges.join(words, ["case_id", "gate"]), _E, family, [F.col("lemma"), F.col("pos")], config)

    return side("dst", "src", "lemma-conditional-follow").unionByName(side("src", "dst", "lemma-conditional-pred"))


def extract(extractors: dict[str, Extractor], config: Config, tables: dict[str, DataFrame], owner: list[str]) -> DataFrame:
    return distinct_features(reduce(DataFrame.unionByName, [f(config, tables) for f in extractors.values()]), owner)


def explain(ftype: Column, arg: Column, config: Config | None = None) -> Column:
    """A feature in words."""
    words = {**EXPLANATIONS, **(config.feature_explain_overrides if config else {})}
    parts = F.split(arg, "\u0001", -1)

    def text(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("%1$s"), F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), F.lit("%2$s"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))

    return reduce(lambda c, k: c.when(ftype == k, text(words[k])), words, F.when(F.lit(False), F.lit(""))).otherwise(F.concat_ws(" ", ftype, arg))
