"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def joined_tokens(text: Column) -> Column:
    """The same, joined by spaces, without making each a string of its own."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """Split after ., ! or ? before white space, and at line ends; blank pieces go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def clean_label(label: Column) -> Column:
    """Line breaks to spaces; white space, full stops and semicolons go at both ends."""
    return F.regexp_replace(F.translate(label, "\n", " "), r"^[\s.;]+|[\s.;]+$", "")


def lower_capitalised(label: Column) -> Column:
    """Lower-case words with only their first letter in upper case; acronyms stay."""
    return F.array_join(F.transform(F.split(label, " ", -1), lambda w: F.when(w.rlike(r"^\p{Lu}\P{Lu}*$"), F.lower(w)).otherwise(w)), " ")


def base_name(path: Column) -> Column:
    """A file's name without folders and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def bag_distance(a: Column, b: Column) -> Column:
    """Sum of |count in a - count in b| over the characters of a plus the same over those of b; shared ones count twice."""

    def side(s: Column, t: Column) -> Column:
        return F.aggregate(
            F.array_distinct(F.split(s, "", -1)),
            F.lit(0),
            lambda n, c: n + F.when(c == "", 0).otherwise(F.abs(_count(s, c) - _count(t, c))),
        )

    return side(a, b) + side(b, a)


def _count(s: Column, c: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, c, F.lit("")))


def harmonic_mean(*xs: Column) -> Column:
    """n / sum(1/x); null if a value is 0."""
    total = sum((1.0 / F.nullif(x, F.lit(0.0)) for x in xs[1:]), 1.0 / F.nullif(xs[0], F.lit(0.0)))
    return len(xs) / total


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
