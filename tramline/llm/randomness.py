"""Secret scans: fixed patterns, and strings that a battery of randomness tests can't tell from random keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, table

#: The base patterns by kind, in the order that kinds are listed in.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
KINDS = [*PATTERNS, "random"]
#: Code points of the second group of an assignment.
LEAST_ASSIGNED = 6
#: Strings that the battery looks at: at least so many symbols, then padding.
LEAST_SYMBOLS = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST_SYMBOLS},}}={{0,2}}"
_DIGITS, _UPPER, _LOWER = "0123456789", UPPER, LOWER
#: Encodings in the order they are tried: the classes of which each has a symbol at least (digits alone are numbers, letters
#: of one case words), and the alphabet in the order of its values.
ENCODINGS = {
    "hex": (("[0-9]", "[a-f]"), _DIGITS + "abcdef"),
    "upper_hex": (("[0-9]", "[A-F]"), _DIGITS + "ABCDEF"),
    "base32": (("[2-7]", "[A-Z]"), _UPPER + "234567"),
    "base36": (("[0-9]", "[a-z]"), _DIGITS + _LOWER),
    "upper_base36": (("[0-9]", "[A-Z]"), _DIGITS + _UPPER),
    "base62": (("[0-9]", "[A-Z]", "[a-z]"), _UPPER + _LOWER + _DIGITS),
    "base64": (("[0-9]", "[A-Z]", "[a-z]"), _UPPER + _LOWER + _DIGITS + "+/"),
}
#: Two symbols of an ordinary string are the same with the probability REPEAT (letters in text: 0.065 to 0.08, names in
#: mixed case and digits: less), and in small alphabets REPEAT_RATIO times as often as in random strings.
REPEAT, REPEAT_RATIO = 0.05, 2.2
#: Bounds for the largest of the three statistics, the widest first, and the share of false discoveries allowed.
BOUNDS, FALSE_SHARE = (3.0, 2.5, 2.0, 1.5, 1.0), 0.05
#: Classes of length: from so many symbols.
LENGTHS = (20, 32, 64, 128)
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column) -> Column:
    """Of an array of whole numbers: for each place, the sum of all before it; blocks of 256 keep that near linear."""

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)

    def places(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def whole(own: Column) -> Column:
        blocks = F.transform(places(F.ceil(F.size(own) / 256).cast("int")), lambda b: total(F.slice(own, b * 256 + 1, 256)))
        starts = let(blocks, lambda x: F.transform(places(F.size(x)), lambda b: total(F.slice(x, F.lit(1), b))))
        return let(starts, lambda s: F.transform(places(F.size(own)), lambda i: F.get(s, F.floor(i / 256).cast("int")) + total(F.slice(own, F.floor(i / 256).cast("int") * 256 + 1, i % 256))))

    return let(lengths, whole)


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>>: the leftmost matches that don't overlap, in code points, end exclusive.

    A text is cut at the matches, so that lengths of what lies between and of the matches give their places.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("own"), h.alias("found")))

        def at(pairs: Column) -> Column:
            before = running(F.transform(pairs, lambda p: p["gap"] + p["own"]))
            return F.zip_with(pairs, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["own"]).alias("end"), p["found"].alias("found")))

        return let(both, at)

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, as array<struct<start, kind, end>>."""
    own = []
    for kind, pattern in PATTERNS.items():
        hits = occurrences(text, pattern)
        if kind == "assign":
            hits = F.filter(hits, lambda h: F.length(F.regexp_extract(h["found"], PATTERNS["assign"], 2)) >= LEAST_ASSIGNED)
        own.append(as_spans(hits, kind))
    return F.concat(*own)


def as_spans(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), h["end"].alias("end"))).cast(_SPAN)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def _normal(z: Column) -> Column:
    """The normal distribution function, by a logistic one (within 0.0002)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z)))


def battery(symbols: Column, alphabet: str) -> Column:
    """struct<uniform, runs, serial>: three statistics, each of mean 0 and variance 1 where symbols are random and independent.

    uniform: chi-squared of all symbols against equal shares, by its exact mean and variance. runs: of Wald and Wolfowitz,
    above and below the middle of the alphabet (100 if all are on one side). serial: of neighbours' values, lag 1.
    Symbols are read in pieces of 1,024, so that memory holds one piece's values only.
    """
    k = len(alphabet)
    n = F.length(symbols).cast("double")
    squares = F.aggregate(F.array(*map(F.lit, alphabet)), F.lit(0).cast("long"), lambda a, s: a + F.pow(F.length(symbols) - F.length(F.replace(symbols, s, F.lit(""))), 2).cast("long"))
    uniform = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("serial"))

    def one(a: Column, symbol: Column) -> Column:
        def valued(v: Column) -> Column:
            first = a["last"].isNull()
            return F.struct(
                v.alias("last"),
                (a["runs"] + F.when(first | ((a["last"] * 2 >= k) != (v * 2 >= k)), 1).otherwise(0)).alias("runs"),
                (a["high"] + F.when(v * 2 >= k, 1).otherwise(0)).alias("high"),
                (a["serial"] + F.when(first, 0).otherwise((2 * a["last"] - (k - 1)) * (2 * v - (k - 1)))).alias("serial"),
            )

        return let(F.instr(F.lit(alphabet), symbol) - 1, valued)

    folded = F.aggregate(F.regexp_extract_all(symbols, F.lit(".{1,1024}"), F.lit(0)), start, lambda a, piece: F.aggregate(F.regexp_extract_all(piece, F.lit("."), F.lit(0)), a, one))

    def tests(x: Column) -> Column:
        high = x["high"].cast("double")
        twice = 2.0 * high * (n - high)
        spread = twice * (twice - n) / (n * n * (n - 1))
        runs = F.when(twice > 0, (x["runs"] - (twice / n + 1)) / F.sqrt(F.when(spread > 0, spread))).otherwise(100.0)
        return F.struct(uniform.alias("uniform"), F.coalesce(runs, F.lit(100.0)).alias("runs"), (x["serial"] * 3.0 / ((k * k - 1) * F.sqrt(n - 1))).alias("serial"))

    return let(folded, tests)


def candidates(text: Column) -> Column:
    """array<struct<start, end, stratum, digest, largest, mean, spread>>: strings of a known encoding, with the battery's largest statistic.

    What the fixed patterns have found as a whole is left out. mean and spread: of the first statistic on ordinary strings
    of that length and alphabet (chi-squared, not central).
    """

    def judged(h: Column) -> Column:
        symbols = F.translate(F.rtrim(h["found"], F.lit("=")), "-_", "+/")
        n = F.length(symbols)
        lengths = F.lit(len(LENGTHS) - 1)
        for i in reversed(range(len(LENGTHS) - 1)):
            lengths = F.when(n < LENGTHS[i + 1], i).otherwise(lengths)

        def within(s: Column) -> Column:
            out = None
            for e, (classes, alphabet) in enumerate(ENCODINGS.values()):
                k = len(alphabet)
                more = (F.length(s) - 1) * (max(REPEAT * k, REPEAT_RATIO) - 1)
                mean = more / F.sqrt(2.0 * (k - 1) * (F.length(s) - 1) / F.length(s))
                tested = let(battery(s, alphabet), lambda b: F.greatest(F.abs(b["uniform"]), F.abs(b["runs"]), F.abs(b["serial"])))
                own = F.struct((lengths + e * len(LENGTHS)).alias("stratum"), tested.alias("largest"), mean.alias("mean"), F.sqrt(1 + 2 * more / (k - 1)).alias("spread"))
                fits = s.rlike(f"^[{alphabet}]+$")
                for c in classes:
                    fits &= s.rlike(c)
                out = F.when(fits, own) if out is None else out.when(fits, own)
            return out

        return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.unhex(F.substring(F.sha2(h["found"], 256), 1, 32)).alias("digest"), let(symbols, within).alias("is"))

    mine = F.filter(occurrences(text, CANDIDATE), lambda h: ~h["found"].rlike(f"^({PATTERNS['access']}|{PATTERNS['hex']})$"))
    return F.filter(F.transform(mine, judged), lambda c: c["is"].isNotNull())


def bounds(found: DataFrame) -> dict[int, float]:
    """found(candidates) -> the bound of each stratum (encoding and class of length): the widest whose share of false discoveries is allowed.

    Strings are counted once, however many documents repeat them. An ordinary string passes a bound with the probability
    that the normal approximation gives for its length. Random strings hardly ever fail the widest bound, so that those that
    do, and one more, over the probability of failing estimate how many are ordinary (as Storey does for p-values); as many
    times the probability of passing are the false discoveries expected, and their share of those that pass is held
    down. Long strings are told from ordinary ones almost surely and get a wide bound; short ones a narrow one, or none.
    """
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.is.stratum", "c.digest").agg(*(F.first(f"c.is.{x}").alias(x) for x in ("largest", "mean", "spread")))
    counts = [F.avg(_normal((F.lit(b) - F.col("mean")) / F.col("spread"))).alias(f"false{i}") for i, b in enumerate(BOUNDS)] + [F.count(F.when(F.col("largest") <= b, 1)).alias(f"pass{i}") for i, b in enumerate(BOUNDS)]
    ordinary = (F.col("all") - F.col("pass0") + 1) / (1 - F.col("false0"))
    chosen = F.coalesce(*(F.when((F.col(f"pass{i}") > 0) & (ordinary * F.col(f"false{i}") <= FALSE_SHARE * F.col(f"pass{i}")), F.lit(b)) for i, b in enumerate(BOUNDS)))
    rows = each.groupBy("stratum").agg(F.count(F.lit(1)).alias("all"), *counts).select("stratum", chosen.alias("bound")).filter("bound is not null")
    return {r.stratum: r.bound for r in rows.collect()}  # at most encodings x classes of length: 28 rows


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, base array<struct<start, kind, end>>, spans of the same kind): one row per input row.

    base: matches of PATTERNS as whole matches, leftmost and not overlapping in each kind, an assignment only with a value of
    LEAST_ASSIGNED or more; kind is the place in KINDS. spans: base and, as kind 3, runs of at least LEAST_SYMBOLS symbols
    of a known encoding on which chi-squared uniformity, runs and serial correlation all stay within the bound of their
    encoding and length (see `bounds`), which is set over all documents so that at most a twentieth of what is found is
    expected to be ordinary. A string that is an access key or hex match as a whole is not given again.

    Null texts are empty; empty texts have no spans. Long texts: matches are placed in near linear time, long strings
    tested in pieces. Ties in start follow the kind. Repeated rows are treated alike, their strings count once. Rows without
    an id stay. Other columns are ignored. An empty table gives an empty result.

    One pass reads texts; what it finds is written out without them, and read for the bounds and for the result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = checkpointed(docs.select(F.col(id_col).alias("_id"), base_spans(text).alias("base"), candidates(text).alias("candidates")))
    bound = bounds(found)

    def passes(c: Column) -> Column:
        if not bound:
            return F.lit(False)
        table_ = F.create_map(*(F.lit(x) for kv in bound.items() for x in kv))
        return F.coalesce(c["is"]["largest"] <= F.try_element_at(table_, c["is"]["stratum"]), F.lit(False))

    more = as_spans(F.filter("candidates", passes), "random")
    return found.select(F.col("_id").alias(id_col), "base", F.concat("base", more).alias("spans"))


def op12_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("base"), kind).alias(f"n_{kind}") for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql_positions(pattern: str, kind: int, name: str) -> str:
    return f"""{name}_cut AS (
  SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits FROM d),
{name}_each AS (SELECT doc_id, unnest(range(len(hits))) AS i, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit FROM {name}_cut WHERE len(hits) > 0),
{name} AS (
  SELECT doc_id, {kind} AS kind, hit,
         sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS s,
         sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM {name}_each)"""


def _sql() -> str:
    # explicit classes: that engine folds case beyond ASCII
    keyword = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    value = "[A-Za-z0-9+/_.=-]+"
    assign = rf"""(?:{keyword})["'']?\x20*[:=]\x20*["'']?({value})"""
    fits = [" AND ".join(f"regexp_matches(core, '{p}')" for p in (f"^[{alphabet}]+$", *classes)) for classes, alphabet in ENCODINGS.values()]
    encoding = "CASE " + " ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(fits)) + " END"
    alphabets = ", ".join(f"({i}, {len(a)}, '{a}', {max(REPEAT * len(a), REPEAT_RATIO) - 1!r})" for i, (_, a) in enumerate(ENCODINGS.values()))
    lengths = "CASE " + " ".join(f"WHEN n < {x} THEN {i}" for i, x in enumerate(LENGTHS[1:])) + f" ELSE {len(LENGTHS) - 1} END"
    z = [f"(({b} - mean) / spread)" for b in BOUNDS]
    false = ", ".join(f"avg(1.0 / (1.0 + exp(-(1.5976 * {x} + 0.07056 * {x} * {x} * {x})))) AS false{i}" for i, x in enumerate(z))
    passed = ", ".join(f"count(*) FILTER (WHERE largest <= {b}) AS pass{i}" for i, b in enumerate(BOUNDS))
    chosen = "CASE " + " ".join(f"WHEN pass{i} > 0 AND (n_all - pass0 + 1) / (1 - false0) * false{i} <= {FALSE_SHARE} * pass{i} THEN {b}" for i, b in enumerate(BOUNDS)) + " END"
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    written_ = f"string_agg({names} || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_positions(assign, 0, "assign")},
{_sql_positions(PATTERNS["access"], 1, "access")},
{_sql_positions(PATTERNS["hex"], 2, "hexes")},
{_sql_positions(CANDIDATE, 3, "strings")},
base AS (
  SELECT doc_id, kind, s, e FROM assign WHERE length(regexp_extract(hit, '{assign}', 1)) >= {LEAST_ASSIGNED}
  UNION ALL SELECT doc_id, kind, s, e FROM access UNION ALL SELECT doc_id, kind, s, e FROM hexes),
cores AS (
  SELECT DISTINCT hit, translate(rtrim(hit, '='), '-_', '+/') AS core FROM strings
  WHERE NOT regexp_matches(hit, '^({PATTERNS["access"]}|{PATTERNS["hex"]})$')),
known AS (SELECT hit, core, length(core) AS n, {encoding} AS enc FROM cores),
alphabets(enc, k, alphabet, excess) AS (VALUES {alphabets}),
tested AS (SELECT hit, core, n::DOUBLE AS n, known.enc, k, alphabet, excess, {lengths} AS cls FROM known JOIN alphabets ON known.enc = alphabets.enc),
symbols AS (
  SELECT hit, k, i, instr(alphabet, substr(core, i::INTEGER + 1, 1)) - 1 AS v
  FROM (SELECT hit, k, alphabet, core, unnest(range(n::BIGINT)) AS i FROM tested)),
squares AS (SELECT hit, sum(c * c) AS squares FROM (SELECT hit, v, count(*) AS c FROM symbols GROUP BY hit, v) GROUP BY hit),
pairs AS (SELECT hit, k, i, v, lag(v) OVER (PARTITION BY hit ORDER BY i) AS u FROM symbols),
folded AS (
  SELECT hit, sum(CASE WHEN u IS NULL OR (2 * u >= k) <> (2 * v >= k) THEN 1 ELSE 0 END) AS runs, sum(CASE WHEN 2 * v >= k THEN 1 ELSE 0 END)::DOUBLE AS high,
         sum(CASE WHEN u IS NULL THEN 0 ELSE (2 * u - (k - 1)) * (2 * v - (k - 1)) END)::DOUBLE AS serial
  FROM pairs GROUP BY hit),
stats AS (
  SELECT t.hit, t.enc * {len(LENGTHS)} + t.cls AS stratum, n, k, excess, 2.0 * high * (n - high) AS twice, runs, serial,
         (squares * k / n - n - (k - 1)) / sqrt(2.0 * (k - 1) * (n - 1) / n) AS uniform
  FROM tested t JOIN squares q ON q.hit = t.hit JOIN folded f ON f.hit = t.hit),
judged AS (
  SELECT hit, stratum,
         greatest(abs(uniform),
                  CASE WHEN twice > 0 AND twice > n THEN abs((runs - (twice / n + 1)) / sqrt(twice * (twice - n) / (n * n * (n - 1)))) ELSE 100.0 END,
                  abs(serial * 3.0 / ((k * k - 1) * sqrt(n - 1)))) AS largest,
         (n - 1) * excess / sqrt(2.0 * (k - 1) * (n - 1) / n) AS mean, sqrt(1 + 2 * (n - 1) * excess / (k - 1)) AS spread
  FROM stats),
strata AS (SELECT stratum, count(*) AS n_all, {false}, {passed} FROM judged GROUP BY stratum),
chosen AS (SELECT stratum, {chosen} AS bound FROM strata),
secrets AS (SELECT hit FROM judged JOIN chosen ON judged.stratum = chosen.stratum WHERE largest <= bound),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, kind, s, e FROM strings JOIN secrets ON secrets.hit = strings.hit),
b AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         {written_} AS spans
  FROM base GROUP BY doc_id),
a AS (SELECT doc_id, {written_} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""


SQL = {"op12_randomness": _sql()}
