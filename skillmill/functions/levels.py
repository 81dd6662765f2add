"""Proficiency levels from what a text says around a skill."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, collapse, is_simple, let, quoted, skill_norm

#: Characters on each side of the first mention that a level is read from.
WINDOW = 220


def _aliases(aliases: Column | str) -> Column:
    return F.filter(F.transform(F.coalesce(_c(aliases), F.array().cast("array<string>")), skill_norm), lambda a: a.isNotNull() & (a != ""))


def searchable(text: Column | str) -> Column:
    """The lower-cased, collapsed text in which mentions are looked for."""
    return F.trim(collapse(F.lower(_c(text))))


def first_mention(text: Column | str, aliases: Column | str, hay: Column | None = None) -> Column:
    """Offset of the first alias in the lower-cased, collapsed text; -1 if there is none. No word ends are asked for.

    ``hay`` is that text where it is there already: computed once for a document, not for each of its skills.
    """

    def found(hay: Column) -> Column:
        at = F.filter(F.transform(_aliases(aliases), lambda a: F.instr(hay, a)), lambda p: p > 0)
        return F.coalesce(F.array_min(at) - 1, F.lit(-1))

    return let(searchable(text) if hay is None else hay, found)


def _year_pattern(a: Column) -> Column:
    loose = is_simple(a) & a.contains(" ")
    tail = F.when(loose, F.concat(F.lit("\\b"), F.regexp_replace(a, " +", r"\\s+"), F.lit("\\b"))).otherwise(quoted(a))
    return F.concat(F.lit(r"(\d+)\s*\+?\s*(?:years?|yrs?)\s+(?:of\s+)?"), tail)


def level_of(text: Column | str, aliases: Column | str) -> Column:
    """1 to 3, by the first rule that holds: no alias in the text 1; expert or advanced 3; intermediate 2; most years
    stated before an alias, 5 or more 3, 3 or more 2, fewer 1; strong, proficient or extensive 2; else 1. Null text gives 1."""

    def graded(hay: Column, names: Column) -> Column:
        # no number gives '', of which a cast would be tried in vain at the price of an exception
        years = F.array_max(F.transform(names, lambda a: F.nullif(F.call_function("regexp_extract", hay, _year_pattern(a), F.lit(1)), F.lit("")).try_cast("int")))
        years = F.when(hay.rlike(r"\d"), years)
        by_years = let(years, lambda y: F.when(y >= 5, 3).when(y >= 3, 2).when(y.isNotNull(), 1).when(hay.rlike("strong|proficient|extensive"), 2).otherwise(1))
        return (
            F.when(~F.exists(names, lambda a: hay.contains(a)), 1)
            .when(hay.rlike(r"\b(expert|advanced)\b"), 3)
            .when(hay.rlike(r"\bintermediate\b"), 2)
            .otherwise(by_years)
        )

    hay = F.coalesce(searchable(text), F.lit(""))
    return let(hay, lambda h: let(_aliases(aliases), lambda names: graded(h, names)))


def level_near(text: Column | str, aliases: Column | str, window: int = WINDOW, hay: Column | None = None) -> Column:
    """``level_of`` the text around the first mention. The offset is found in the collapsed text and used in the text as it
    is, so the window drifts where white space was collapsed; kept as the result is relied on. No mention: the whole text."""
    text = _c(text)

    def part(at: Column) -> Column:
        lo = F.greatest(at - window, F.lit(0))
        return F.when(at < 0, text).otherwise(F.substring(text, lo + 1, at + window - lo))

    return let(first_mention(text, aliases, hay), lambda at: let(part(at), lambda p: level_of(p, aliases)))
