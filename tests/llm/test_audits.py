"""Edge cases and brute-force checks of whitening, secret scans and the filter audit."""

import hashlib
import math
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from tramline.llm import audit, randomness, whitening

KEY = "".join(random.Random(5).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=60))


# ---- whitening


def exact_fit(vectors):
    """Whole numbers, sums and the covariance, in fractions."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - b for a, b in zip(r, s)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(len(s))] for i in range(len(s))]
    return n, d, cov


def test_outer_products_and_sums_are_exact():
    rng = random.Random(1)
    for top in (3, 2**19, 2**40, 2**61, 2**75):
        rows = [[rng.randint(-top, top) for _ in range(3)] for _ in range(50)] + [[top, -top, 0]]
        d = np.array(rows, object if top > 2**62 else np.int64)
        high, low = np.zeros((3, 3)), np.zeros((3, 3))
        for p in whitening.outer_products(d):
            high, low = whitening.add_double(high, low, p)
        for i in range(3):
            for j in range(3):
                exact = sum(r[i] * r[j] for r in rows)
                assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= Fraction(top) ** 2 * 51 / 2**98
    big = np.array([[2**61, -5], [2**61 - 3, 7]])
    assert whitening.centred(big, 10**6, (17, -3)).tolist() == [[10**6 * 2**61 - 17, -5 * 10**6 + 3], [10**6 * (2**61 - 3) - 17, 7 * 10**6 + 3]]


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(60, 10)) * np.arange(1, 11) * 1e3 + 1e6).tolist() + [[1e6] * 10] * 2
    other = [[1.0, 2.0], [3.0, 5.0], [-4.0, 0.5]]
    rows = [(i, v, i, 0.5) for i, v in enumerate(good + other)]
    rows += [(None, good[0], 1, None), (900, None, 1, 1.0), (901, [1.0, None] * 5, 1, 1.0), (902, [float("nan")] + [1.0] * 9, 1, 1.0), (903, [float("inf")] * 10, None, 1.0), (904, [], 1, 1.0), (905, [1e300] * 10, 1, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n double").repartition(5)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 63 * 8 + 3 * 2
    for vectors, ids in ((good + [good[0]], [*range(62), None]), (other, [62, 63, 64])):
        n, d, cov = exact_fit(vectors)
        values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
        values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
        expected = np.array([[float(Fraction(c, n)) for c in r] for r in d]) @ axes / np.sqrt(values)
        trace = float(sum(cov[i][i] for i in range(len(cov))))
        for k in range(len(values)):
            own = got[(got.component == k + 1) & (got.n == n)]
            found = {None if math.isnan(r.vec_id) else int(r.vec_id): r for r in own.itertuples()}
            assert set(found) == set(ids) and own.identity_error.nunique() == 1 and own.identity_error.max() < 1e-9
            sign = np.sign(found[ids[0]].whitened * expected[0, k])
            for at, i in enumerate(ids):
                assert int(found[i].deviation) == sum(c * c for c in d[at])
                assert found[i].whitened * sign == pytest.approx(expected[at, k], abs=1e-9) and found[i].explained == pytest.approx(values[k] / trace, rel=1e-9)


def test_whitening_of_few_or_equal_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], kind)).toPandas()
    assert one.whitened.isna().all() and (one.deviation == 0).all() and (one.explained == 0).all() and (one.identity_error == 0).all() and len(one) == 3
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0])], kind)).toPandas()
    assert sorted(two[two.component == 1].whitened) == pytest.approx([-1, 1]) and two[two.component > 1].whitened.isna().all() and two.identity_error.max() < 1e-12


# ---- secret scans


def brute_spans(text):
    out = []
    for kind, p in enumerate((randomness.PATTERNS["assign"], "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        for m in re.finditer(p, text, re.ASCII):
            if len(m[2] if kind == 0 else m[0]) >= (6, 20, 24)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


SECRETS = [
    None, "", " ", "password=hunter2 and PASSWD : \"abcdef\" but token: token: abcdefg", "api_key='x.y-z=12' apikey:aaaaa secret==abcdef ſecret=abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "é𝒳 AKIAAKIA" + "7" * 12, "é𝒳 " + "ab12" * 6 + " " + "f" * 23 + " " + "0" * 24 + "g" + "e" * 30,
    "token=" + "ab" * 20, f"𝒳 {KEY} and password={KEY[:30]}", "SoManyWordsInOneIdentifierName2024 the/path/To/some/File2/of/the/other/Users 123456789012345678901234",
    "no keys " * 3 + KEY, "token=abcdef " * 3000, "deadbeef" * 50_000, ("x" * 9 + " ") * 20_000,
]


@pytest.fixture(scope="module")
def secrets(spark):
    rows = [(i, t, "a", i) for i, t in enumerate(SECRETS)] + [(3, SECRETS[3], None, None), (None, SECRETS[8], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, base int").repartition(4)


def test_base_spans_against_re(secrets):
    got = randomness.scan(secrets).collect()
    assert len(got) == len(SECRETS) + 2
    for r in got:
        text = (SECRETS[8] if r.doc_id is None else SECRETS[r.doc_id]) or ""
        assert sorted(map(tuple, r.base)) == brute_spans(text)
        more = [tuple(s) for s in r.spans if s["kind"] == 3]
        assert sorted(map(tuple, r.spans)) == sorted([*map(tuple, r.base), *more])
        at = text.find(KEY)
        assert ((at, 3, at + 60) in more) == (at >= 0)
        if r.doc_id not in (7, 8, 10, None):
            assert not more, text[:80]
    assert randomness.scan(secrets.filter("false")).count() == 0


def brute_battery(s, alphabet):
    k, n, v = len(alphabet), len(s), [alphabet.index(c) for c in s]
    chi = sum((s.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    high = sum(2 * x >= k for x in v)
    runs = 1 + sum((2 * a >= k) != (2 * b >= k) for a, b in zip(v, v[1:]))
    mean = 2 * high * (n - high) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    serial = sum((a - middle) * (b - middle) for a, b in zip(v, v[1:])) / (spread * math.sqrt(n - 1))
    return (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n), (runs - mean) / math.sqrt(variance), serial


def test_battery_against_plain_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    for _, alphabet in randomness.ENCODINGS.values():
        strings = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (20, 33, 1024, 1025, 5000)] + [alphabet * 2]
        df = spark.createDataFrame([(s,) for s in strings], "s string")
        for r in df.select("s", randomness.battery(F.col("s"), alphabet).alias("b")).collect():
            assert tuple(r.b) == pytest.approx(brute_battery(r.s, alphabet), abs=1e-9)
        one_side = spark.createDataFrame([(alphabet[0] * 30,)], "s string").select(randomness.battery(F.col("s"), alphabet).alias("b")).first()
        assert one_side.b.runs == 100 and one_side.b.uniform > 10


def test_random_keys_are_found_and_words_left(spark):
    """Two hundred keys of each encoding among ordinary long strings: most keys found, at most a twentieth of the finds ordinary."""
    rng = random.Random(9)
    words = "process order Invoice customer Service report number Value account payment Request delivery Status system Network data".split()
    keys = {"".join(rng.choice(a) for _ in range(rng.choice((24, 32, 40, 64)))) for _, a in list(randomness.ENCODINGS.values())[3:] for _ in range(50)}
    plain = {rng.choice(("", "-", "_", "/")).join(rng.choice(words) for _ in range(5)) + str(rng.randint(1, 2030)) for _ in range(400)}
    texts = [" ".join(["some", s, "here"]) for s in sorted(keys | plain)]
    rows = randomness.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {texts[r.doc_id][s["start"] : s["end"]] for r in rows for s in r.spans if s["kind"] == 3}
    assert len(found & keys) >= 0.8 * len(keys) and len(found - keys) <= 0.05 * len(found), (len(found & keys), len(keys), found - keys)


def test_places_of_many_matches(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3] * n,) for n in (0, 1, 255, 256, 257, 1000)], "a array<long>").select(randomness.running(F.col("a")).alias("r"))
    assert [r.r for r in df.collect()] == [[3 * i for i in range(n)] for n in (0, 1, 255, 256, 257, 1000)]


# ---- filter audit

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, None, None), (2, "", "a"), (3, LONG, "a"), (4, LONG, "b"), (5, LONG, None), (6, "Ab " * 300, "a"), (7, LONG + " $", "a"), (8, LONG.upper() + "\x0b|", "b"),
    (9, "x\ty\nz\x0cu\rv  w", "b"), (3, LONG, "a"), (3, "another text", "a"), (None, LONG, "a"), (None, "lone", None), (12, "Word word é " * 40_000, "a"), (13, "1 A 2345678901234567890123456789012345678901234567", "b"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (5, 0, 0), (7, 1, None), (8, None, 1), (None, 1, 1), (12, 1, 1)]


def brute_audit():
    def fails(doc_id, text):
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        copies = [i for i, u, _ in DOCS if (u or "") == t and i is not None]
        return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), doc_id is not None and min(copies) < doc_id)

    marks = {i: (any(q == 1 for j, q, _ in LABELS if j == i), any(x == 1 for j, _, x in LABELS if j == i)) for i, _, _ in LABELS if i is not None}
    rows = [(part or "", dict(zip("ABCDE", fails(i, t))), *marks.get(i, (False, False))) for i, t, part in DOCS]
    out, shapley = {}, {}
    for part in {p for p, *_ in rows}:
        own = [r for r in rows if r[0] == part]
        for p in permutations("ABCDE"):
            left = own
            for k, f in enumerate(p):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(p), k + 1] = [len(stay), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = stay
    return {key: tuple(v) + (shapley[key[0], key[1][key[2] - 1]],) for key, v in out.items()}


def test_audit_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, s, 1, "c") for i, t, s in DOCS], "doc_id long, text string, source string, step int, kept string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in audit.audit(docs, labels).collect()}
    assert got == brute_audit() and len(got) == 3 * 600
    assert audit.audit(docs.filter("false"), labels).count() == 0
    assert audit.audit(docs, labels.filter("false")).selectExpr("sum(good_lost) + sum(toxic_lost)").first()[0] == 0


def test_queries_read_whole_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    for r in randomness.op12_randomness(spark, data).collect():
        text = next(d.text for d in docs if d.doc_id == r.doc_id) or ""
        base = brute_spans(text)
        written = ",".join(f"{randomness.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").count()
    out = whitening.op11_whitening(spark, data).toPandas()
    assert len(out) == 8 * vectors and out.identity_error.max() < 1e-9 and out.n.eq(vectors).all()
    for c in range(1, 9):
        y = out[out.component == c].whitened
        assert abs(y.mean()) < 1e-9 and abs((y**2).mean() - 1) < 1e-9
