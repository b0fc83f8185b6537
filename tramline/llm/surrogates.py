"""PII: detected entities are replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import checkpointed, sliced, table

#: Production parameters of op6. A deployment passes a secret of its own.
KEY = b"tramline-surrogates"
#: Up to so many entities that had to be drawn again go to the tasks as a table; more are joined.
MOST_SENT = 5_000
_MOST_ROUNDS = 50

#: Titles that a person's name follows, by gender ("" if a title says nothing of it).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Signora", "г-жа", "Госпожа", "κυρία", "Κα"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Don", "Signor", "г-н", "Господин", "κύριος", "Κος"],
    "": ["Dr", "Prof", "Professor"],
}
#: Syllables and endings of surrogate names by script and gender ("s": surname).
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ja", "jo", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "ta", "te", "to", "va", "ve", "wa", "we", "za"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "ни", "па", "по", "ра", "ро", "са", "се", "та", "то", "фа"],
    "greek": ["βα", "γα", "δα", "δη", "ζα", "θα", "κα", "κο", "λα", "λε", "μα", "με", "να", "νι", "πα", "πε", "ρα", "ρο", "σα", "στε", "τα", "φι"],
}
ENDINGS = {
    "latin": {"f": ["na", "ra", "lia"], "m": ["rd", "n", "rt"], "": ["n", "l", "r"], "s": ["mann", "son", "ler", "rez"]},
    "cyrillic": {"f": ["на", "ра", "лия"], "m": ["н", "р", "слав"], "": ["н", "р"], "s": ["нко", "ских", "дзе"]},
    "greek": {"f": ["να", "ρα", "λία"], "m": ["ρος", "νης", "ς"], "": ["ς"], "s": ["ου", "ίδης", "άκη"]},
}

_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
#: Words within a name that are none of it by themselves; they stay, as do initials.
PARTICLES = ["van", "von", "vom", "zu", "zur", "der", "den", "dem", "ter", "ten", "de", "del", "della", "di", "da", "das", "dos", "do", "du", "des", "la", "le", "y", "e", "bin", "ibn", "al", "el"]
_FIRST = r"[^\W\d_a-zà-ÿа-яё]"
#: Letters, with a hyphen or an apostrophe before a letter; what English puts after an apostrophe is no part of the name.
_WORD = _FIRST + r"(?:[^\W\d_]|[-‐'’](?!(?:s|d|m|t|ll|re|ve)\b)(?=[^\W\d_]))+"
_WORDS = r"(?:(?:" + "|".join(PARTICLES) + "|" + _FIRST + r"\.) )*" + _WORD
_TITLE = "(?:" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)) + r")\.? "
#: Titles in a row (Frau Dr.), then the name.
_NAME = re.compile(rf"(?<!\w)((?:{_TITLE})+)({_WORDS}(?: {_WORDS})*)")
#: Titles of a language that writes headlines in capitals; after them a longer run than LONGEST words is the
#: first two and what recurs elsewhere in the text.
HEADLINES, LONGEST = {"Mrs", "Ms", "Miss", "Mr", "Dr", "Prof", "Professor"}, 3
#: Names that are words or dates as well. They, and words that the text has in lower case too, are replaced
#: beside a title or another word of a name only.
COMMON = set(
    "april august autumn baker bill bishop black bond brown bush carter church cook cross day dean drew english faith field fields fisher ford forest foster fox frank "
    "french friday gold grace grant gray green hall hill holiday hope hunter ivory jack january joy june king knight lake land lane law little long love march mark marsh mason may miller "
    "monday moon noble north page park parker pierce potter power price prince rice rich rose said south spring stone summer sunday thursday tuesday walker west white will winter wood woods young".split()
)
#: So many words of a name may be in a script without capitals; further ones begin with a capital.
_WITHOUT_CAPITALS = 3
#: In this order; a span that is taken is not looked at again. Of secrets, group 1 is what is replaced. A pattern is
#: looked for in texts with one of its strings alone, as no match can be without; () says any text with a digit.
PATTERNS = [
    ("secret", re.compile(r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----([A-Za-z0-9+/=\s]{16,})-----END "), ("PRIVATE KEY",)),
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b\"?\s*[:=]\s*[\"']?([^\s\"',;<>]{6,})"), (":", "=")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)([0-9A-Z]{16})\b"), ("AKIA", "ASIA")),
    ("secret", re.compile(r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_)([A-Za-z0-9_-]{16,})"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk_live_")),
    ("secret", re.compile(r"\beyJ([A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"), ("eyJ",)),
    ("secret", re.compile(r"\bBearer ([A-Za-z0-9._~+/-]{16,}=*)"), ("Bearer ",)),
    ("secret", re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s/@]{3,})@"), ("://",)),
    ("email", re.compile(r"@[\w-]++(?:\.[\w-]++)+"), ("@",)),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), ()),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"), (".",)),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::[0-9A-Fa-f]{1,4}){0,6}(?:[0-9A-Fa-f]{1,4})?(?![\w:]|\.\d)|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:)(?::[0-9A-Fa-f]{1,4}){2,6}(?![\w:]|\.\d)"), (":",)),
    ("ssn", re.compile(r"(?<![\w-])(?<!\d )(?!000|666|9)\d{3}([- ])\d{2}\1\d{4}(?![\w-]| \d)"), ()),
    ("card", re.compile(r"(?<![\w+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"), ()),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])(?:1[.-])?[2-9]\d{2}([.-])\d{3}\1\d{4}(?![\w-]|\.\d)|(?<![\w.,+/-])(?<!\d )0[1-9]\d{1,3}[ /-]\d{5,8}(?![\w/-]|[.,]\d| \d)"), ()),
]
#: Calling codes of countries that have one or two digits; all others have three.
SHORT_CODES = {"1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}
_LOCAL = re.compile(r"[\w.%+-]")
_SPOKEN = re.compile(r"[^\W\d_]+(?:[-‐'’][^\W\d_]+)*")
#: What numbers of payment cards begin with.
_ISSUERS = re.compile("4|5[0-8]|6|2[2-7]|3[0-9]")
_DIGIT = re.compile(r"\d")
_HEX = re.compile("[0-9a-f]+|[0-9A-F]+")


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Addresses, read from each @ to the left, so that a long run without one is never tried place by place."""
    end = 0
    for m in pattern.finditer(text):
        at = m.start()
        while at > end and _LOCAL.match(text, at - 1):
            at -= 1
        if at < m.start():
            end = m.end()
            yield at, end


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, kind, canonical value), by place.

    Names are found word by word after a title; then their words are looked for in the whole text, so that later mentions
    without a title, or of the surname alone, are the same entities.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []

    taken = bytearray()  # a byte for each place, once there is an entity

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def put(a: int, b: int, kind: str, value: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        taken[a:b] = b"\x01" * (b - a)
        found.append((a, b, kind, value))

    digits = _DIGIT.search(text)
    for kind, pattern, hints in PATTERNS:
        if not any(h in text for h in hints) if hints else not digits:
            continue
        for a, b in _emails(text, pattern) if kind == "email" else (m.span(1 if kind == "secret" else 0) for m in pattern.finditer(text)):
            value = text[a:b].rstrip(".") if kind in ("email", "secret") else text[a:b]
            b = a + len(value)
            if not free(a, b) or kind == "iban" and _iban_rest(value.replace(" ", "")) != 1:
                continue
            if kind == "card" and not (_ISSUERS.match(value) and _luhn(re.sub(r"\D", "", value))):
                continue  # some other long number
            if kind == "email":
                value = value.lower()
            elif kind == "ip" and ":" in value:
                if value.count(":") < 3 and "::" not in value or not re.search(r"\d", value):
                    continue  # a time or two words
                try:
                    value = ipaddress.IPv6Address(value).exploded
                except ValueError:
                    continue
            elif kind in ("phone", "card", "iban", "ssn"):
                value = "+" * value.startswith("+") + re.sub(r"[^A-Z0-9]", "", value)
            put(a, b, kind, value)
    if any(t in text for t in _GENDER):
        named: dict[str, str] = {}
        forms: set[str] = set()
        stand = Counter(_SPOKEN.findall(text))
        for m in _NAME.finditer(text):
            titles = [t.rstrip(".") for t in m[1].split()]
            gender = next((g for t in titles if (g := _GENDER[t])), "")
            words: list[str] = []
            for w in m[2].split(" "):
                if w not in PARTICLES and not w.endswith("."):
                    if len(words) >= _WITHOUT_CAPITALS and not w[0].isupper():
                        break
                    words.append(w)
            if len(words) > LONGEST and titles[-1] in HEADLINES:
                own = Counter(_SPOKEN.findall(m[2]))
                words = words[:2] + [w for w in words[2:] if stand[w] > own[w]]
            for n, w in enumerate(words):
                kind, value = "surname" if n == len(words) - 1 else f"given_{gender}", w.casefold()
                if named.get(value, "given_") == "given_":  # a gender once told holds in the text
                    named[value] = kind
                forms |= {w, w.upper()}
        if forms:
            unsure = {w for w in forms if w.casefold() in COMMON or w.lower() != w and stand[w.lower()]}
            again = re.compile(r"(?<![\w])(?:" + "|".join(sorted(map(re.escape, forms), key=len, reverse=True)) + r")(?!\w|[-‐'’](?!(?:s|d|m|t|ll|re|ve)\b)[^\W\d_])")
            for m in again.finditer(text):
                if free(*m.span()) and (m[0] not in unsure or _beside_name(text, *m.span(), forms)):
                    put(*m.span(), named[m[0].casefold()], m[0].casefold())
    return sorted(found)


def _beside_name(text: str, a: int, b: int, forms: set[str]) -> bool:
    """Whether a title or another word of a name stands right before, or such a word right after."""
    before, after = text[max(0, a - 80) : a], text[b : b + 80]
    left = before.rsplit(maxsplit=1)[-1] if before.endswith(" ") and before.strip() else ""
    right = re.match(r" ([^\W\d_]+(?:[-‐'’][^\W\d_]+)*)", after)
    return left.rstrip(".") in _GENDER or left in forms or left in PARTICLES and _beside_name(text, a - 1 - len(left), a - 1, forms) or bool(right) and right[1] in forms


class _Draw:
    """Numbers from a keyed stream that an entity and an attempt decide."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.pool, self.turn = key, "\x1f".join(what).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            block = hmac.new(self.key, self.what + self.turn.to_bytes(4, "big"), sha256).digest()
            self.pool, self.turn = self.pool << 256 | 1 << 255 | int.from_bytes(block, "big") >> 1, self.turn + 1
        self.pool, x = divmod(self.pool, n)
        return x

    def like(self, s: str) -> str:
        """Class by class: digits for digits, letters for letters of the same case, all else as it is."""
        hexa = len(s) >= 8 and _HEX.fullmatch(s) and not s.isalpha() and not s.isdigit()
        out = []
        for c in s:
            if hexa:
                x = "0123456789abcdef"[self.below(16)]
                out.append(x.upper() if s.isupper() else x)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    draw = _Draw(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        name, _, end = domain.rpartition(".")
        return f"{draw.like(local)}@{_Draw(key, 'domain', domain).like(name)}.{end}"
    if kind == "ip" and ":" in value:
        return value[:5] + ":".join(f"{draw.below(65535) + 1:04x}" for _ in range(7))
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "phone":
        n = 1
        if value[0] == "+":
            n += next((k for k in (1, 2) if value[1 : 1 + k] in SHORT_CODES), 3)
        return value[:n] + str(2 + draw.below(8)) + draw.like(value[n + 1 :])
    if kind == "card":
        body = value[:4] + draw.like(value[4:-1])
        return body + next(d for d in "0123456789" if _luhn(body + d))
    if kind == "iban":
        body = draw.like(value[4:])
        return f"{value[:2]}{98 - _iban_rest(value[:2] + '00' + body):02d}{body}"
    if kind in ("secret", "ssn"):
        return draw.like(value)
    script = "cyrillic" if "а" <= value[0] <= "ё" else "greek" if "α" <= value[0] <= "ω" or value[0] in "άέήίόύώ" else "latin"
    gender = "s" if kind == "surname" else kind.rpartition("_")[2]
    syllables = SYLLABLES[script]
    ends = ENDINGS[script][gender]
    return "".join(syllables[draw.below(len(syllables))] for _ in range(3 if attempt < 5 else 5)) + ends[draw.below(len(ends))]


def shaped(value: str, original: str, kind: str) -> str:
    """A canonical surrogate in the original's writing: its separators and its use of capitals."""
    if kind in ("phone", "card", "iban", "ssn"):
        left = iter(value.lstrip("+"))
        return "".join(next(left, "") if c.isalnum() else c for c in original)
    if kind == "email":
        return value.upper() if original.isupper() else value
    if kind == "ip" and ":" in value:
        return ipaddress.IPv6Address(value).compressed if len(original) < 39 else value
    if kind == "surname" or kind.startswith("given"):
        return value.upper() if original.isupper() else value[:1].upper() + value[1:]
    return value


def replace(text: str | None, key: bytes, told: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and their spans in it. told: the kind and attempt of entities where they are not their own kind and 0."""
    out, spans, at, length = [], [], 0, 0
    for a, b, kind, value in find(text):
        kind, attempt = told.get((kind, value), (kind, 0))
        new = shaped(surrogate(key, kind, value, attempt), text[a:b], kind)
        out += [text[at:a], new]
        length += a - at
        spans.append({"kind": kind, "start": length, "end": length + len(new)})
        length, at = length + len(new), b
    return (text if not spans else "".join([*out, text[at:]])), spans


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [(h, kind, value) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, value in {x[2:] for x in find(t)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["_hash", "kind", "value"])


def _space() -> Column:
    """Kinds whose surrogates must differ: all names of persons are one space."""
    return F.when(F.col("kind").rlike("^(given_|surname)"), F.lit("name")).otherwise(F.col("kind")).alias("_space")


def draw_again(entities: DataFrame, key: bytes) -> DataFrame:
    """Distinct (kind, value) -> (kind, value, attempt) of the entities that need an attempt other than 0.

    A surrogate that is some entity itself, or that a smaller one has too, is drawn again, until all are distinct and
    new; then entities and surrogates are one to one. First names and surnames are held against each other as well.
    Checks are joins and counts by surrogate.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v, a = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *x) for x in zip(k, v, a)], pa.string())], ["kind", "value", "attempt", "new"])

    kinds = "kind string, value string, attempt int"
    now = checkpointed(entities.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(drawn, f"{kinds}, new string"))
    real = entities.select(_space(), F.col("value").alias("new"), F.lit(True).alias("_real")).distinct()
    for _ in range(_MOST_ROUNDS):
        held = now.select("*", _space())
        # the holder that stays is one settled before, if any: the fewest attempts, then the smallest kind and value
        shared = held.groupBy("_space", "new").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("attempt", "kind", "value")).alias("_first")).filter("_n > 1")
        bad = held.join(real, ["_space", "new"], "left").join(shared, ["_space", "new"], "left")
        bad = bad.filter("_real or (_n > 1 and (value <> _first.value or kind <> _first.kind))")
        bad = checkpointed(bad.select("kind", "value", (F.col("attempt") + 1).cast("int").alias("attempt")))
        if not bad.head(1):
            return now.filter("attempt > 0").select("kind", "value", "attempt")
        now = checkpointed(now.join(bad, ["kind", "value"], "left_anti").union(bad.mapInArrow(drawn, f"{kinds}, new string")))
    raise RuntimeError(f"surrogates still collide after {_MOST_ROUNDS} rounds")


def _told(entities: DataFrame, key: bytes) -> DataFrame:
    """-> (kind, value, to_kind, attempt) of the entities that are not their own kind at attempt 0.

    A first name whose gender some titles do not tell takes the one that others tell, if it is only one.
    """
    genders = entities.filter("kind in ('given_', 'given_f', 'given_m')").groupBy("value").agg(F.sort_array(F.collect_set("kind")).alias("_k"))
    known = genders.filter((F.size("_k") == 2) & (F.get("_k", F.lit(0)) == "given_")).select(F.lit("given_").alias("kind"), "value", F.get("_k", F.lit(1)).alias("to_kind"))
    known = checkpointed(known)
    again = draw_again(entities.join(known.select("kind", "value"), ["kind", "value"], "left_anti"), key)
    of = again.select(F.col("kind").alias("to_kind"), "value", "attempt")
    renamed = known.join(of, ["to_kind", "value"], "left").select("kind", "value", "to_kind", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return again.select("kind", "value", F.col("kind").alias("to_kind"), "attempt").union(renamed)


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """-> docs' own columns with text_col replaced, and entities array<struct<kind, start, end>> of spans in the new text.

    Kinds: email, phone, ip, card, ssn, iban, secrets (tokens, passwords, access keys, private keys) and names. One
    value has one surrogate in the whole corpus, whatever its writing (coreference), and two values never share one,
    nor is a surrogate some other real value (distinctness; first names and surnames together). Phones keep their
    country's calling code, cards their issuer and the validity of the check digit, IBANs their country and a right check
    number, emails their pattern and top domain (equal domains stay equal), secrets their alphabet, names their gender,
    script and capitals. A name is found by a title, or titles in a row, before it; its words are replaced wherever they stand in that text, words
    that are ordinary ones too (COMMON, or in lower case in the text) beside a title or another word of the name only.
    Names map word by word, so a surname alone keeps its surrogate. A first name has one surrogate for each gender that
    titles tell of it; where a title tells none, it takes the gender that others tell, if it is only one.
    Null texts stay null, empty ones empty, both without entities; texts without entities are unchanged. Repeated rows
    come out alike. Other columns are passed through under any name but "entities", which is replaced. An empty table
    gives an empty result.

    Texts stay where they lie. The pass that collects entities shuffles them alone, combined by value first. Only those
    that were drawn again or take another's gender have to be told to the tasks: up to most_sent as a table, beyond that
    by a join on the text's hash.
    """
    own = [c for c in docs.columns if c != "entities"]
    base = docs.select(F.struct(*[_named(c) for c in own]).alias("_row"), F.xxhash64(_named(text_col)).alias("_hash"), _named(text_col).alias("_text"))
    met = base.select("_hash", "_text").mapInArrow(_entities, "_hash long, kind string, value string")
    entities = checkpointed(met.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("_n")).select("kind", "value"))
    far = checkpointed(_told(entities, key))
    few = far.limit(most_sent + 1).collect()
    told: dict[tuple[str, str], tuple[str, int]] = {}
    if len(few) <= most_sent:
        told = {(r[0], r[1]): (r[2], r[3]) for r in few}
        base = base.select("_row", F.lit(None).cast("array<struct<kind: string, value: string, to_kind: string, attempt: int>>").alias("_told"))
    else:
        by_text = met.join(far, ["kind", "value"]).groupBy("_hash").agg(F.collect_set(F.struct("kind", "value", "to_kind", "attempt")).alias("_told"))
        base = base.join(by_text, "_hash", "left").select("_row", F.coalesce("_told", F.array()).alias("_told"))
    at = own.index(text_col)
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([docs.schema[c] for c in own] + [StructField("entities", ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = batch.column(0).flatten()
            pairs = [replace(t, key, told if own_told is None else {(x["kind"], x["value"]): (x["to_kind"], x["attempt"]) for x in own_told}) for t, own_told in zip(columns[at].to_pylist(), batch.column(1).to_pylist())]
            columns[at] = pa.array([p[0] for p in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p[1] for p in pairs], kind)], [*own, "entities"])

    return base.mapInArrow(run, schema)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
