"""Token functions: as columns for the corpus, as plain Python for the query side."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What identifiers, their parts and query words are.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
#: Runs of one identifier: an acronym before a word, a word, an acronym, digits.
CASE_RUNS = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
LOWER = string.ascii_lowercase
WORD_WITH_DASH = "[a-zA-Z_][a-zA-Z0-9_-]*"
#: Words that carry no meaning in a query.
STOPWORDS = frozenset("a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split())


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it several times or inside lambdas."""
    return F.transform(F.array(value), body)[0]


def identifier_parts(token: Column) -> Column:
    """The lower-cased identifier, followed by its parts if it has two or more."""
    whole = F.lower(token)
    by_underscore = F.filter(F.split(whole, "_"), lambda p: p != "")
    by_case = F.transform(F.regexp_extract_all(token, F.lit(CASE_RUNS), F.lit(0)), lambda p: F.lower(p))
    parts = F.when(F.contains(token, F.lit("_")), by_underscore).otherwise(by_case)
    # an identifier of small letters only is its own single part
    cut = bound(parts, lambda p: F.when(F.size(p) >= 2, F.concat(F.array(whole), p)).otherwise(F.array(whole)))
    return F.when(F.translate(token, LOWER, "") == "", F.array(token)).otherwise(cut)


def tokens(text: Column) -> Column:
    """All identifiers of a text with their parts, in order; null text gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.flatten(F.transform(found, identifier_parts))


def identifier_parts_of(token: str) -> list[str]:
    """``identifier_parts`` of one string."""
    whole = token.lower()
    parts = [p for p in whole.split("_") if p] if "_" in token else [p.lower() for p in re.findall(CASE_RUNS, token)]
    return [whole, *parts] if len(parts) >= 2 else [whole]


def tokens_of(text: str) -> list[str]:
    """``tokens`` of one string."""
    return [p for t in re.findall(IDENTIFIER, text) for p in identifier_parts_of(t)]


def lines_with_ends(text: Column) -> Column:
    """Lines with their terminators (``\\n``, ``\\r\\n`` or a lone ``\\r``); together they are the text."""
    return F.regexp_extract_all(text, F.lit("[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+"), F.lit(0))


def newlines(text: Column) -> Column:
    """Number of ``\\n``."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
