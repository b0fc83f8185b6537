"""Texts and labels to token tables; the analyser is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nlp

TOKENS = "tok_id int, form string, lemma string, pos string, vform string, wn string, begin int, end int, role string, is_head boolean, is_predicate boolean, in_condition boolean"
_FIELDS = [c.split()[0] for c in TOKENS.split(", ")]

Analyser = Callable[[str], list[nlp.Token]]


def _row(t: nlp.Token) -> tuple:
    return t.id, t.form, t.lemma, t.pos, t.vform, None, t.begin, t.end, t.role, t.is_head, t.is_predicate, t.in_condition


def analyse_texts(texts: DataFrame, analyser: Analyser | None = None) -> DataFrame:
    """texts(case_id, text) -> tokens(case_id, sent_id from 1, sentence, TOKENS); null texts have none."""
    analyse = analyser or (lambda s: nlp.annotate(nlp.tokenise(s)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, text in zip(pdf["case_id"], pdf["text"]):
                for n, (_, sentence) in enumerate(nlp.split_sentences(text or ""), 1):
                    rows += [(case, n, sentence, *_row(t)) for t in analyse(sentence)]
            yield pd.DataFrame(rows, columns=["case_id", "sent_id", "sentence", *_FIELDS])

    return texts.select("case_id", "text").mapInPandas(run, f"case_id string, sent_id int, sentence string, {TOKENS}")


def analyse_labels(labels: DataFrame) -> DataFrame:
    """labels(case_id, elem_id, elem_type, name) -> label tokens(case_id, elem_id, elem_type, TOKENS); unnamed ones have none.

    Predicates carry the lemma of the action, so an action noun (transmission) is a predicate with its verb's lemma.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, elem, type_, name in zip(pdf["case_id"], pdf["elem_id"], pdf["elem_type"], pdf["name"]):
                if not isinstance(name, str) or not name.strip():
                    continue
                parsed = nlp.parse_label(name, "task" if type_ == "Task" else "other")
                rows += [(case, elem, type_, *_row(t)) for t in parsed.tokens]
                spoken = {t.lemma for t in parsed.tokens if t.is_predicate}
                n = len(parsed.tokens)
                rows += [(case, elem, type_, n + i, v, v, "action", None, None, None, None, None, False, True, False) for i, v in enumerate(parsed.predicates) if v not in spoken]
            yield pd.DataFrame(rows, columns=["case_id", "elem_id", "elem_type", *_FIELDS])

    return labels.select("case_id", "elem_id", "elem_type", "name").mapInPandas(run, f"case_id string, elem_id string, elem_type string, {TOKENS}")


def resolve_anaphoras(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """mentions(case_id, entity_id, seq, sent_id, tok_id): later mentions that are pronouns take the first one's token, but keep their place."""
    at = ["case_id", "sent_id", "tok_id"]
    w = Window.partitionBy("case_id", "entity_id").orderBy("seq")
    ranked = mentions.withColumn("_s", F.first("sent_id").over(w)).withColumn("_t", F.first("tok_id").over(w)).withColumn("_r", F.row_number().over(w))
    later = ranked.filter("_r > 1").select(*at, "_s", "_t").join(tokens.filter("pos = 'pronoun'").select(*at), at, "left_semi").dropDuplicates(at)
    taken = ["form", "lemma", "pos", "vform", "wn"]
    first = tokens.select("case_id", F.col("sent_id").alias("_s"), F.col("tok_id").alias("_t"), *[F.col(c).alias(f"_{c}") for c in taken])
    found = later.join(first, ["case_id", "_s", "_t"]).select(*at, *[f"_{c}" for c in taken], F.lit(True).alias("_hit"))
    out = tokens.join(found, at, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in tokens.columns])
