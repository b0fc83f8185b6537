"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Production parameters of op1. At most SAMPLE_ROWS labelled rows are used for fitting.
SAMPLE_ROWS, TREES, DEPTH, PENALTY, THRESHOLD = 16_000, 60, 3, 0.002, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules speak of; each reads the whole text with built-in functions. text must not be null."""
    n = F.length(text)
    lines, words = F.split(text, "\n", -1), F.split(F.trim(text), " +", -1)

    def count(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(text, pattern, ""))

    return {
        "_chars": n,
        "_upper": count("\\p{Lu}+"),
        "_marks": count("[!?#$%&*+=<>~^_|\\\\/@{}\\[\\]]+"),
        "_shouts": n - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "_pipes": n - F.length(F.replace(text, F.lit("|"), F.lit(""))),
        "_digits": count("[0-9]+"),
        "_stops": count("[.,;:]+"),
        "_lines": F.size(lines),
        "_own_lines": F.size(F.array_distinct(lines)),
        "_words": F.size(words),
        "_own_words": F.size(F.array_distinct(words)),
    }


#: Features of a document as quotients of statistics, so that they do not depend on its length.
def features() -> dict[str, Column]:
    chars, words, lines = F.col("_chars") + 1.0, F.col("_words") + 0.0, F.col("_lines") + 0.0
    return {
        "size": F.log(chars),
        "upper": F.col("_upper") / chars,
        "marks": F.col("_marks") / chars,
        "shouts": F.col("_shouts") / chars,
        "pipes": F.col("_pipes") / chars,
        "digits": F.col("_digits") / chars,
        "stops": F.col("_stops") / chars,
        "stops_a_word": F.col("_stops") / words,
        "word_size": F.col("_chars") / words,
        "line_size": F.col("_chars") / lines,
        "line_variety": F.col("_own_lines") / lines,
        "word_variety": F.col("_own_words") / words,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, over?, bound): feature > bound if over, else feature <= bound."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > F.lit(x) if over else F.col(f) <= F.lit(x) for f, over, x in self.parts])

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[f] > b if over else x[f] <= b for f, over, b in self.parts])


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a column over features(): no Python at scoring."""
        terms = [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def _grow(binned: np.ndarray, target: np.ndarray, edges: list[np.ndarray], depth: int, rng: np.random.Generator):
    """A regression tree over binned features. -> ([paths as ((feature, over, bound), ...)], prediction per row)."""
    paths, prediction, width = [], np.zeros(len(target)), binned.shape[1]
    least = max(3, min(20, len(target) // 20))  # rows of a node

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            paths.append(path)
        best = (1e-12, -1, 0)
        if left and len(rows) >= 2 * least:
            for f in rng.choice(width, max(1, int(np.ceil(0.6 * width))), replace=False):
                k = len(edges[f]) + 1
                n = np.cumsum(np.bincount(binned[rows, f], minlength=k))[:-1]
                s = np.cumsum(np.bincount(binned[rows, f], target[rows], minlength=k))[:-1]
                total = target[rows].sum()
                fine = (n >= least) & (len(rows) - n >= least)
                gain = np.where(fine, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), int(f), int(gain.argmax()))
        if best[1] < 0:
            prediction[rows] = target[rows].mean() if len(rows) else 0
            return
        _, f, at = best
        low = binned[rows, f] <= at
        split(rows[low], (*path, (f, False, float(edges[f][at]))), left - 1)
        split(rows[~low], (*path, (f, True, float(edges[f][at]))), left - 1)

    split(np.arange(len(target)), (), depth)
    return paths, prediction


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty on all but the intercept, by accelerated proximal gradient."""
    n, k = x.shape
    mean, spread = x.mean(axis=0, dtype=float), np.maximum(x.std(axis=0, dtype=float), 0.05)
    z = (x - mean.astype(np.float32)) / spread.astype(np.float32)
    step = 4.0 / (float(np.linalg.norm(z.T @ z / n, 2)) + 1.0)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(z @ v.astype(np.float32) + c, -30, 30))) - y).astype(np.float32)
        was, was_b = w, b
        w = v - step * (z.T @ error / n)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = c - step * error.mean()
        now = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, t = w + (t - 1) / now * (w - was), b + (t - 1) / now * (b - was_b), now
    weights = w / spread
    return b - float(weights @ mean), weights


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 1) -> RuleModel:
    """Boosted shallow trees propose rules (every path to a node), lasso keeps a few of them with weights.

    Ties between splits go to the first feature drawn; equal rules count once. One class only gives a constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))))
    names, rng = list(x), np.random.default_rng(seed)
    matrix = np.stack([x[f] for f in names], axis=1)
    edges = [np.unique(np.quantile(matrix[:, i], np.linspace(0, 1, 66)[1:-1])) for i in range(matrix.shape[1])]
    binned = np.stack([np.searchsorted(e, matrix[:, i], "left") for i, e in enumerate(edges)], axis=1)
    raw, found = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        gradient = y - 1 / (1 + np.exp(-raw))
        paths, _ = _grow(binned[rows], gradient[rows], edges, int(rng.integers(1, depth + 1)), rng)
        for p in paths:
            found.setdefault(Rule(tuple(sorted((names[f], over, bound) for f, over, bound in p))))
        tree = np.zeros(len(y))
        for p in paths:  # a leaf's value is the mean of its own rows; inner nodes are overwritten by their leaves
            own = np.logical_and.reduce([matrix[:, f] > b if over else matrix[:, f] <= b for f, over, b in p])
            tree[own] = gradient[own].mean() if own.any() else 0
        raw = np.clip(raw + 2.0 * tree, -6, 6)
    rules = list(found)
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0))
    intercept, weights = _lasso(held, y.astype(float), penalty) if rules else (float(np.log(share / (1 - share))), np.zeros(0))
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def _described(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep)
    counted = base.select("_id", *keep, *[c.alias(n) for n, c in statistics(F.col("_text")).items()])
    return counted.select("_id", *keep, *[c.alias(n) for n, c in features().items()])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most sample_rows labelled rows: those of the smallest hashes among the ids not held out.

    The bounded set of ids is broadcast, so fitting reads the texts once and shuffles none. A repeated label row counts
    once, the greater label wins; labelled ids without a document and null labels do not count.
    """
    known = labels.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label")).filter("_key is not null and _label is not null")
    known = known.filter(~held_out(F.col("_key"))).groupBy("_key").agg(F.max("_label").alias("_label"))
    sample = known.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col("_key"))
    x = _described(rows, id_col, text_col, "_label").dropDuplicates(["_id"]).toPandas().sort_values("_id")
    return fit_rules({f: x[f].to_numpy(dtype=float) for f in features()}, x["_label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """-> (id_col, held_out boolean, score double, predicted int), one row per input row, in one pass without a shuffle.

    Scores depend on the text alone. Null texts count as empty, and empty texts have a score like others.
    Repeated rows have equal scores; a row without an id is not held out. Other columns are ignored; an empty table
    gives an empty result.
    """
    scored = _described(docs, id_col, text_col).select("_id", model.column().alias("score"))
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score threshold or more, with all their columns under their own names."""
    whole = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # The row number keeps the optimiser from pushing the filter down, which would write the statistics out again at every rule.
    scored = _described(whole, id_col, text_col, "_row").select("_row", model.column().alias("_score"), F.monotonically_increasing_id().alias("_at"))
    return scored.filter((F.col("_score") >= threshold) & (F.col("_at") >= 0)).select("_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
