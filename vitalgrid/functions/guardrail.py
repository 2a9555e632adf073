"""Wording checks over whole text drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid import codebook as cb

# Unicode white space spelled out, because the regex engines differ
# in what \s and \d cover; (?md) lets ^ match after a line feed only.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LIST_PATTERN = rf"(?md)^{_SPACE}*(?:#{{1,6}}{_SPACE}|[-*]{_SPACE}|\p{{Nd}}+\.{_SPACE})"
STRIP_PATTERN = rf"^{_SPACE}+|{_SPACE}+\z"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_PATTERN, "")


def contains_any(lowered: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases])


def required_flags(text: Column) -> dict[str, Column]:
    """One boolean per required wording, so a failure can be explained."""
    lowered = F.lower(text)
    return {name: contains_any(lowered, phrases) for name, phrases in cb.REQUIRED_PHRASES.items()}


def prohibited_claims(text: Column) -> Column:
    """The prohibited phrases the text contains, in list order."""
    lowered = F.lower(text)
    phrases = F.array(*[F.lit(p) for p in cb.PROHIBITED_CLAIMS])
    return F.filter(phrases, lambda phrase: F.contains(lowered, phrase))


def makes_prohibited_claim(text: Column) -> Column:
    return contains_any(F.lower(text), cb.PROHIBITED_CLAIMS)


def has_list_markup(text: Column) -> Column:
    """Markdown heading, bullet or numbered line anywhere in the text."""
    return text.rlike(LIST_PATTERN)


def passes(text: Column) -> Column:
    required = reduce(lambda a, b: a & b, required_flags(text).values())
    return required & ~makes_prohibited_claim(text) & ~has_list_markup(text)
