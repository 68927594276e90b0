"""Title and category filters, as column expressions or over arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substrings that rule out links and categories.
LINK_BLACKLIST = ["wikipedia", "category", "identifier", "help", "template", ":", "wayback", "isbn", "jstor"]
CATEGORY_BLACKLIST = ["wiki", "cs1", "articles", "pages", "redirects", "template", "disputes", "iso", "dmy", "short", "s1"]
#: Characters, not a prefix, that are stripped from the left of a raw category.
CATEGORY_CHARACTERS = "Category:"


def _alternation(parts: list[str]) -> str:
    return "|".join(re.escape(p.lower()) for p in parts)


def has_substring(text: Column, blacklist: list[str]) -> Column:
    """Whether the lower-cased text has any of the substrings; with no substrings, never."""
    return F.lower(text).rlike(_alternation(blacklist)) if blacklist else F.lit(False)


def without_substrings(df: DataFrame, column: str, blacklist: list[str]) -> DataFrame:
    """Rows whose text has none of the substrings, in their own case. Null texts are dropped."""
    return df.where(F.col(column).isNotNull() & ~has_substring(F.col(column), blacklist))


def without_words(df: DataFrame, column: str, blacklist: list[str]) -> DataFrame:
    """Rows none of whose white-space-separated words is in the list; the text comes back in lower case. Null texts are dropped."""
    lower = F.lower(F.col(column))
    words = F.split(F.trim(lower), r"\s+")
    listed = F.array(*(F.lit(w) for w in blacklist)) if blacklist else F.array().cast("array<string>")
    return df.where(F.col(column).isNotNull() & ~F.arrays_overlap(words, listed)).withColumn(column, lower)


def strip_category(text: Column, strict_prefix: bool = False) -> Column:
    """Strips the characters of ``Category:`` from the left; with ``strict_prefix``, that prefix alone."""
    return F.regexp_replace(text, "^Category:", "") if strict_prefix else F.ltrim(text, F.lit(CATEGORY_CHARACTERS))


def category_set(categories: Column, blacklist: list[str]) -> Column:
    """The distinct categories of an array that have no blacklisted substring; null gives an empty array."""
    kept = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: c.isNotNull() & ~has_substring(c, blacklist))
    return F.array_distinct(kept)
