"""Similarities of feature vectors by a sparse equi-join on features."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import ratio

_c = F.col
#: name -> column over the pair's sums: n_i, w_i, w_min, dot, and per side n, w, l2 (t: text, m: model). Pairs without a shared feature have 0.
FUNCTIONS: dict[str, Callable[[], Column]] = {
    "cosine": lambda: F.least(ratio(_c("dot"), _c("t_l2") * _c("m_l2")), F.lit(1.0)),
    "jaccard": lambda: _c("n_i") / (_c("t_n") + _c("m_n") - _c("n_i")),
    "fake-jaccard": lambda: _c("n_i") / F.least("t_n", "m_n"),
    "raw-weighted-overlapping": lambda: _c("w_i"),
    "weighted-fake-jaccard": lambda: ratio(_c("w_i"), F.when(_c("t_n") <= _c("m_n"), _c("t_w")).otherwise(_c("m_w"))),
    "weighted-jaccard": lambda: ratio(_c("w_i"), _c("t_w") + _c("m_w") - _c("w_min")),
}


#: Functions that need the weights of all features of a text: of every text, or of those alone that have no more features than some model.
NEEDS = {"cosine": "all", "weighted-jaccard": "all", "weighted-fake-jaccard": "short"}
#: The sums that a function reads.
USES = {
    "cosine": ["dot", "t_l2", "m_l2"],
    "jaccard": ["n_i", "t_n", "m_n"],
    "fake-jaccard": ["n_i", "t_n", "m_n"],
    "raw-weighted-overlapping": ["w_i"],
    "weighted-fake-jaccard": ["w_i", "t_n", "m_n", "t_w", "m_w"],
    "weighted-jaccard": ["w_i", "w_min", "t_w", "m_w"],
}


def totals(features: DataFrame, owner: list[str], side: str) -> DataFrame:
    return features.groupBy(*owner).agg(
        F.count(F.lit(1)).alias(f"{side}_n"), F.sum("weight").alias(f"{side}_w"), F.sqrt(F.sum(_c("weight") * _c("weight"))).alias(f"{side}_l2")
    )


def pair_sums(text: DataFrame, model: DataFrame, case: list[str], sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """Sums over shared features of each (case, sent, elem) that shares any.

    The join meets on the feature, never on the case alone, so pairs without a shared feature cost nothing. Common
    lemmas make large join partitions, which adaptive execution splits; sums are combined before the next shuffle.
    """
    t, m = _with_totals(text, [*case, sent], "t"), _with_totals(model, [*case, elem], "m")
    return _summed(t.join(m, [*case, "ftype", "arg"]), [*case, sent, elem])


class Few:
    """The features of a few models, sent to every task: rows by term (first[t] to first[t + 1]) with the number of their element and their weight."""

    def __init__(self, model: DataFrame, elem: str = "elem_id"):
        rows = _with_totals(model, [elem], "m").toArrow()
        self.elem, self.kind = elem, model.schema[elem].dataType.simpleString()
        self.vocabulary = sorted(set(rows["arg"].to_pylist()))
        term = pc.index_in(rows["arg"].combine_chunks(), value_set=pa.array(self.vocabulary, rows["arg"].type)).to_numpy(zero_copy_only=False).astype(np.int64)
        owners = rows[elem].combine_chunks().dictionary_encode()
        order = np.argsort(term, kind="stable")
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        number = owners.indices.to_numpy()
        self.number, self.weight = number[order], rows["_mw"].to_numpy()[order]
        self.elems, one = owners.dictionary, np.unique(number, return_index=True)[1]
        self.sides = {c: rows[c].to_numpy()[one] for c in ("m_n", "m_w", "m_l2")}
        self.longest = int(self.sides["m_n"].max(initial=0))


#: Cells (text, model) and shared features of a block of texts: so few that its matrices stay in the cache.
CELLS, SHARED = 1 << 15, 1 << 17


class _Block:
    """The sums of some texts with all models, as matrices: (text, term) entries meet the term's models, and are added up by (text, model) cell."""

    def __init__(self, texts: pa.RecordBatch, few: Few, term: np.ndarray, n_terms: np.ndarray, weight: np.ndarray, times: np.ndarray):
        self.texts, self.few, self.shape = texts, few, (texts.num_rows, len(few.elems))
        row = np.repeat(np.arange(texts.num_rows), n_terms)
        met = np.arange(times.sum()) + np.repeat(few.first[term] - (np.cumsum(times) - times), times)
        self._row, self._elem = np.repeat(row, times), few.number[met]
        self._cell = self._row * len(few.elems) + self._elem
        self._t_weight, self._m_weight = np.repeat(weight, times), few.weight[met]
        self.here = np.zeros(self.shape, bool)
        self.here.ravel()[self._cell] = True

    def __getitem__(self, name: str) -> np.ndarray:
        """A sum of pair_sums; those of a side alone have one column or row."""
        if name in self.few.sides:
            return self.few.sides[name][None, :]
        if name in ("t_n", "t_w", "t_l2"):
            return self.texts.column("n_terms" if name == "t_n" else name).to_numpy(zero_copy_only=False)[:, None].astype(np.int64 if name == "t_n" else float)
        if name == "n_i":
            return np.bincount(self._cell, minlength=self.here.size).reshape(self.shape)
        if name == "w_i":
            x = self._m_weight
            if (self["t_n"] <= self.few.longest).any():
                x = np.where(self["t_n"].ravel()[self._row] <= self.few.sides["m_n"][self._elem], self._t_weight, x)
        else:
            x = np.minimum(self._t_weight, self._m_weight) if name == "w_min" else self._t_weight * self._m_weight
        return np.bincount(self._cell, x, self.here.size).astype(float).reshape(self.shape)  # of no cells at all it makes whole numbers

    def pairs(self, sent: str, values: Sequence[np.ndarray]) -> list[pa.Array]:
        """Ids and values of the pairs that share a feature; those that are not a number are null."""
        cells = np.flatnonzero(self.here)
        text, elem = np.divmod(cells, self.shape[1])
        found = [np.broadcast_to(v, self.shape).ravel()[cells] for v in values]
        return [self.texts.column(sent).take(pa.array(text)), self.few.elems.take(pa.array(elem)), *[pa.array(v, from_pandas=True) for v in found]]


def _blocks(batches: Iterator[pa.RecordBatch], few: Few, scale: np.ndarray, cells: int = CELLS, shared: int = SHARED) -> Iterator[_Block]:
    """Blocks of texts whose cells and shared features are bounded (a text at least), so that memory depends on the models alone."""
    for texts in batches:
        lists = texts.column("terms")
        n_terms, term = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        weight = texts.column("counts").flatten().to_numpy(zero_copy_only=False) / np.repeat(texts.column("n_tokens").to_numpy(zero_copy_only=False), n_terms) * scale[term]
        times = few.first[term + 1] - few.first[term]
        first = np.append(0, np.cumsum(n_terms))
        before, at = np.append(0, np.cumsum(times))[first], 0
        while at < len(lists):
            fits = np.searchsorted(before, before[at] + shared, side="right") - 1
            end = min(len(lists), max(at + 1, min(fits, at + cells // max(1, len(few.elems)))))
            own = slice(first[at], first[end])
            yield _Block(texts.slice(at, end - at), few, term[own], n_terms[at:end], weight[own], times[own])
            at = end


def _read(text: DataFrame, sent: str, columns: Sequence[str]) -> DataFrame:
    return text.select(sent, "n_tokens", "n_terms", "terms", "counts", *[c for c in ("t_w", "t_l2") if c in columns])


def _ids(text: DataFrame, few: Few, sent: str) -> tuple[str, str]:
    return f"{sent} {text.schema[sent].dataType.simpleString()}", f"{few.elem} {few.kind}"


def local_pair_sums(text: DataFrame, few: Few, scale: np.ndarray, columns: Sequence[str], sent: str = "sent_id") -> DataFrame:
    """The named columns of pair_sums for many texts with few models, summed where a text lies: neither its features nor its pairs are shuffled.

    text: rows of features.known_counts over few.vocabulary, with t_w and t_l2 where columns name them. A term weighs its frequency
    times its scale.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, few, scale):
            yield pa.RecordBatch.from_arrays(block.pairs(sent, [block[c] for c in columns]), [sent, few.elem, *columns])

    kinds = [f"{c} {'long' if c in ('n_i', 't_n', 'm_n') else 'double'}" for c in columns]
    return _read(text, sent, columns).mapInArrow(summed, ", ".join([*_ids(text, few, sent), *kinds]))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b != 0)


#: FUNCTIONS over a block's matrices.
ARRAYS: dict[str, Callable[[_Block], np.ndarray]] = {
    "cosine": lambda b: np.minimum(_over(b["dot"], b["t_l2"] * b["m_l2"]), 1.0),
    "jaccard": lambda b: (n := b["n_i"]) / (b["t_n"] + b["m_n"] - n),
    "fake-jaccard": lambda b: b["n_i"] / np.maximum(np.minimum(b["t_n"], b["m_n"]), 1),
    "raw-weighted-overlapping": lambda b: b["w_i"],
    "weighted-fake-jaccard": lambda b: _over(b["w_i"], np.where(b["t_n"] <= b["m_n"], b["t_w"], b["m_w"])),
    "weighted-jaccard": lambda b: _over(b["w_i"], b["t_w"] + b["m_w"] - b["w_min"]),
}


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To so many digits, halves away from 0."""
    y = np.abs(x) * 10.0**digits
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 10.0**digits, x)


def local_similarities(text: DataFrame, few: Few, scale: np.ndarray, name: str, sent: str = "sent_id", digits: int | None = None, lengths: dict | None = None) -> DataFrame:
    """-> (sent, elem, sim) from the rows of local_pair_sums, without them: weighed and rounded where they are summed.

    lengths: of each element's vector, by which sim is divided; null where that is 0.
    """
    size = None if lengths is None else np.array([lengths.get(e) or np.nan for e in few.elems.to_pylist()], float)[None, :]

    def weighed_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, few, scale):
            sim = ARRAYS[name](block)
            sim = sim if size is None else sim / size
            yield pa.RecordBatch.from_arrays(block.pairs(sent, [sim if digits is None else rounded(sim, digits)]), [sent, few.elem, "sim"])

    return _read(text, sent, USES[name]).mapInArrow(weighed_block, ", ".join([*_ids(text, few, sent), "sim double"]))


#: Rows that a task keeps for best sentences before it drops those that have become worse.
KEPT = 1 << 18
_SUMS = ["t_max", "t_sum", "t_sq", "t_plogp", "t_pos", "t_real"]


def local_statistics(text: DataFrame, few: Few, scale: np.ndarray, name: str, dummy: int, digits: int, sent: str = "sent_id") -> DataFrame:
    """Similarities folded by element where texts lie: no pair leaves a task. Two kinds of rows; see predictors.folded.

    One row for each task and element that shares a feature with any text there, with t_max and sums for predictors.statistics, which
    are to be added up; and (elem, sent, sim) for each similarity that could still be the greatest when rounded to so many digits, of equal
    ones the smallest sent.
    """
    slack, names = 2 * 10.0**-digits, [few.elem, *_SUMS, "t_dummies", sent, "sim"]

    def best(near: pa.Table, top: np.ndarray) -> pa.Table:
        near = near.filter(pa.array(near["sim"].to_numpy() >= top[near["elem"].to_numpy()] - slack))
        return near.group_by(["elem", "sim"], use_threads=False).aggregate([("sent", "min")]).rename_columns(["elem", "sim", "sent"])

    def candidates(near: pa.Table) -> Iterator[pa.RecordBatch]:
        for rows in near.to_batches():
            none = [pa.nulls(len(rows), pa.float64())] * len(_SUMS)
            yield pa.RecordBatch.from_arrays([few.elems.take(rows["elem"]), *none, pa.nulls(len(rows), pa.int64()), rows["sent"], rows["sim"]], names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, near = np.full(len(few.elems), -np.inf), None
        sums, dummies = np.zeros((len(_SUMS) - 1, len(few.elems))), np.zeros(len(few.elems), np.int64)
        for block in _blocks(batches, few, scale):
            sim = np.where(block.here, ARRAYS[name](block), 0.0)
            off = pc.equal(block.texts.column(sent), dummy).to_numpy(zero_copy_only=False)
            positive = np.maximum(sim, 0.0)
            plogp = positive * np.log(positive, out=np.zeros(sim.shape), where=positive > 0)
            total = sim.sum(0)
            sums += [total, (sim * sim).sum(0), plogp.sum(0), positive.sum(0), total - sim[off].sum(0)]
            dummies += block.here[off].sum(0)
            found = np.where(block.here, sim, -np.inf)
            top = np.maximum(top, found.max(0, initial=-np.inf))
            row, elem = np.nonzero(block.here & (found >= top - slack))
            rows = pa.table({"elem": elem, "sim": sim[row, elem], "sent": block.texts.column(sent).take(pa.array(row))})
            near = rows if near is None else pa.concat_tables([near, rows])
            if len(near) > KEPT:
                near = best(near, top)
                if len(near) > KEPT // 2:
                    yield from candidates(near)
                    near = None
        if near is not None:
            yield from candidates(best(near, top))
        some = np.flatnonzero(top > -np.inf)
        none = sums[3, some] <= 0  # without a positive one there is no entropy
        columns = [pa.array(x[some], mask=none if c in ("t_plogp", "t_pos") else None) for c, x in zip(_SUMS, [top, *sums])]
        end = [pa.array(dummies[some]), pa.nulls(len(some), text_kind), pa.nulls(len(some), pa.float64())]
        yield pa.RecordBatch.from_arrays([few.elems.take(pa.array(some)), *columns, *end], names)

    text_kind = to_arrow_type(text.schema[sent].dataType)
    own, other = _ids(text, few, sent)
    return _read(text, sent, USES[name]).mapInArrow(fold, ", ".join([other, *[f"{c} double" for c in _SUMS], "t_dummies long", own, "sim double"]))


def local_sentence_statistics(text: DataFrame, few: Few, scale: np.ndarray, name: str, sent: str = "sent_id") -> DataFrame:
    """-> (sent, s_max, s_sum) for texts that share a feature with any model."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, few, scale):
            sim, some = ARRAYS[name](block), pa.array(block.here.any(1))
            columns = [np.where(block.here, sim, -np.inf).max(1, initial=-np.inf), np.where(block.here, sim, 0.0).sum(1)]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in (block.texts.column(sent), *map(pa.array, columns))], [sent, "s_max", "s_sum"])

    return _read(text, sent, USES[name]).mapInArrow(fold, f"{_ids(text, few, sent)[0]}, s_max double, s_sum double")


def _with_totals(features: DataFrame, owner: list[str], side: str) -> DataFrame:
    both = features.join(totals(features, owner, side), owner)
    return both.select(*owner, "ftype", "arg", _c("weight").alias(f"_{side}w"), f"{side}_n", f"{side}_w", f"{side}_l2")


def _summed(both: DataFrame, pair: list[str]) -> DataFrame:
    shorter = F.when(_c("t_n") <= _c("m_n"), _c("_tw")).otherwise(_c("_mw"))
    return both.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_i"), F.sum(shorter).alias("w_i"), F.sum(F.least("_tw", "_mw")).alias("w_min"), F.sum(_c("_tw") * _c("_mw")).alias("dot"),
        *[F.max(x).alias(x) for x in ("t_n", "t_w", "t_l2", "m_n", "m_w", "m_l2")],
    )


def similarities(text: DataFrame, model: DataFrame, name: str, case: list[str], sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """-> (case, sent, elem, sim) for the pairs that share a feature; all others have similarity 0."""
    return weighed(pair_sums(text, model, case, sent, elem), name, [*case, sent, elem])


def weighed(sums: DataFrame, name: str, pair: list[str]) -> DataFrame:
    return sums.select(*pair, FUNCTIONS[name]().alias("sim"))


def all_pairs(sims: DataFrame, sentences: DataFrame, elements: DataFrame, case: list[str], sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """The dense matrix of each case (cases are small): missing pairs have 0."""
    pairs = sentences.select(*case, sent).join(elements.select(*case, elem), case)
    return pairs.join(sims, [*case, sent, elem], "left").select(*case, sent, elem, F.coalesce("sim", F.lit(0.0)).alias("sim"))


def l2_normalised(sims: DataFrame, case: list[str], elem: str = "elem_id") -> DataFrame:
    """Similarities over the length of their element's vector; null where that is 0. Lengths are combined first, then joined."""
    size = sims.groupBy(*case, elem).agg(F.sqrt(F.sum(_c("sim") * _c("sim"))).alias("_l2"))
    return sims.join(size, [*case, elem]).withColumn("sim", _c("sim") / F.nullif("_l2", F.lit(0.0))).drop("_l2")


def family_sums(text: DataFrame, model: DataFrame, families: Sequence[str], case: list[str], sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """pair_sums for features whose families all weigh 1, kept apart by family: arrays in the order of families.

    -> (case, sent, elem, n_i, t_n, m_n, and arrays w_i, w_min, dot, t_w, t_sq, m_w, m_sq). A family's weight only scales its own
    entries, so that any number of settings is weighed from these rows without joining features again; see weigh.
    """

    def each(x: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(_c("ftype") == f, x)), F.lit(0.0)) for f in families])

    def side(features: DataFrame, owner: list[str], name: str) -> DataFrame:
        w = _c("weight")
        return features.groupBy(*owner).agg(F.count(F.lit(1)).alias(f"{name}_n"), each(w).alias(f"{name}_w"), each(w * w).alias(f"{name}_sq"))

    t_all, m_all = side(text, [*case, sent], "t"), side(model, [*case, elem], "m")
    t = text.join(t_all.select(*case, sent, "t_n"), [*case, sent]).select(*case, sent, "ftype", "arg", _c("weight").alias("_tw"), "t_n")
    m = model.join(m_all.select(*case, elem, "m_n"), [*case, elem]).select(*case, elem, "ftype", "arg", _c("weight").alias("_mw"), "m_n")
    shorter = F.when(_c("t_n") <= _c("m_n"), _c("_tw")).otherwise(_c("_mw"))
    both = t.join(m, [*case, "ftype", "arg"]).groupBy(*case, sent, elem)
    pairs = both.agg(F.count(F.lit(1)).alias("n_i"), each(shorter).alias("w_i"), each(F.least("_tw", "_mw")).alias("w_min"), each(_c("_tw") * _c("_mw")).alias("dot"))
    return pairs.join(t_all, [*case, sent]).join(m_all, [*case, elem])


def weigh(sums: DataFrame, settings: dict[str, dict[str, float]], name: str, families: Sequence[str], case: list[str], sent: str = "sent_id", elem: str = "elem_id") -> DataFrame:
    """family_sums -> (setting, case, sent, elem, sim) for every setting, whose weights by family must not be negative.

    A fold of each row over the settings, which are one constant of the plan; no join and no shuffle.
    """
    if any(w[f] < 0 for w in settings.values() for f in families):
        raise ValueError("weights must not be negative")
    table = F.from_json(F.lit(json.dumps([{"setting": k, "w": [w[f] for f in families]} for k, w in settings.items()])), "array<struct<setting:string,w:array<double>>>")
    rows = sums.select("*", F.explode(table).alias("_s"))

    def total(c: str, squared: bool = False) -> Column:
        scaled = F.zip_with(c, "_s.w", lambda x, w: x * w * w if squared else x * w)
        return F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)

    folded = rows.select(
        _c("_s.setting").alias("setting"), *case, sent, elem, "n_i", "t_n", "m_n", *[total(c).alias(c) for c in ("w_i", "w_min", "t_w", "m_w")],
        total("dot", True).alias("dot"), F.sqrt(total("t_sq", True)).alias("t_l2"), F.sqrt(total("m_sq", True)).alias("m_l2"),
    )
    return folded.select("setting", *case, sent, elem, FUNCTIONS[name]().alias("sim"))
