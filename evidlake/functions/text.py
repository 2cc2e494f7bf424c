"""Column functions on texts: tokens, terms, years, numbers, sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that define results.
TOKEN = r"\$?\d+(?:\.\d+)?%?|[a-zA-Z]+(?:\.[a-zA-Z]+)?"
TERM = r"[a-zA-Z][a-zA-Z-]+"
YEAR = r"\b(?:19|20)\d{2}\b"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?%?"
PLAIN_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
MENTION = r"\$?\d+(?:,\d{3})*(?:\.\d+)?%?"
QUOTED = r"""['"]([^'"]+)['"]"""
REWRITE_TERM = r"[a-zA-Z][a-zA-Z&.-]*"
STOPWORDS = "a an and are as at be by did for from in is it of on or that the to was were what which with".split()
REWRITE_STOPWORDS = [*STOPWORDS, "does", "if", "when", "who"]
DOMAIN_STOPWORDS = "amount average change company difference fiscal million percentage total year".split()


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def tokenize(c: Column) -> Column:
    return find_all(F.lower(c), TOKEN)


def content_terms(c: Column, also: list[str] | None = None) -> Column:
    """Set of terms of three letters or more that are no stopwords."""
    stop = texts([*STOPWORDS, *(also or [])])
    return F.array_distinct(F.filter(find_all(F.lower(c), TERM), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


def years(c: Column) -> Column:
    return find_all(c, YEAR)


def numbers(c: Column) -> Column:
    """Numbers as written, dollar signs dropped."""
    return find_all(F.replace(c, F.lit("$"), F.lit("")), NUMBER)


def plain_numbers(c: Column) -> Column:
    """Numbers as doubles, without thousands commas."""
    return F.transform(find_all(c, PLAIN_NUMBER), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def number_mentions(c: Column) -> Column:
    return find_all(c, MENTION)


def quoted_phrases(c: Column) -> Column:
    return F.transform(find_all(c, QUOTED, 1), strip)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_any(c: Column, phrases: list[str]) -> Column:
    return F.exists(texts(phrases), lambda p: F.contains(c, p))


def first_by_lower(items: Column) -> Column:
    """Items without blanks and later repeats in any letter case."""
    kept = F.filter(F.transform(items, strip), lambda t: t != "")

    def add(seen: Column, t: Column) -> Column:
        return F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.concat(seen, F.array(t)))

    return F.aggregate(kept, F.array().cast("array<string>"), add)
