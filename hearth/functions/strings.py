"""String functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text holds one of the keywords anywhere (not bound to words); null text: false."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(k.lower()) for k in keywords], F.lit(False))


def equal_ignoring_case(c: Column, value: str | None) -> Column:
    """Equality without regard to case; no value means no restriction."""
    return F.lit(True) if not value else F.lower(c) == value.lower()


def display_name(given: Column, family: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", given, family)), F.lit("")), fallback)


def either_contains(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return a.contains(b) | b.contains(a)


def same_prefix(a: Column, b: Column, n: int) -> Column:
    return F.lower(F.substring(a, 1, n)) == F.lower(F.substring(b, 1, n))


def hl7_escape(c: Column) -> Column:
    """Escapes the five delimiters, the escape character first; null becomes empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for plain, code in (("\\", "\\E\\"), ("|", "\\F\\"), ("^", "\\S\\"), ("&", "\\T\\"), ("~", "\\R\\")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def address_tokens(c: Column, abbreviations: dict[str, str]) -> Column:
    """Distinct lower-cased tokens of an address, abbreviated forms made equal token by token."""
    tokens = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair]) if abbreviations else None
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(table[t], t)) if table is not None else tokens)


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens over the larger of two token sets; 0 if one is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def split_pair(c: Column, separator: str = "/") -> tuple[Column, Column]:
    """The two integers of "a/b"; null unless there are two parts."""
    parts = F.split(c, separator)
    two = F.size(parts) == 2
    return F.when(two, F.try_element_at(parts, F.lit(1)).try_cast("int")), F.when(two, F.try_element_at(parts, F.lit(2)).try_cast("int"))


def wait_text(minutes: Column) -> Column:
    """"Xm" below an hour, else "Xh Ym"."""
    whole = F.floor(minutes).cast("int")
    return F.when(whole < 60, F.format_string("%dm", whole)).otherwise(F.format_string("%dh %dm", F.floor(whole / 60).cast("int"), whole % 60))


def extension_value(extensions: Column, suffix: str, field: str) -> Column:
    """The field of the last extension whose url ends so."""
    return F.try_element_at(F.filter(extensions, lambda e: e["url"].endswith(suffix)), F.lit(-1))[field]


def ordered_case(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first regular expression found in the text."""
    out = None
    for pattern, label in rules:
        hit = c.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return (out if out is not None else F.lit(None)).otherwise(F.lit(default)) if out is not None else F.lit(default)


#: Compares by the root locale: case is ignored, accents count and stand beside their letters.
LOCALE = "UNICODE_CI"


def by_locale(c: Column) -> Column:
    """A string that compares, sorts, groups and joins by locale, without regard to case."""
    return F.collate(c, LOCALE)
