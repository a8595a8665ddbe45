"""Ranking: query classes, boosts, penalties and saturation.

Boosts work on ``scored(chunk_id, score)`` joined with the chunks. What depends
only on the query is decided on the driver and enters the plan as literals.
"""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import bare, parent_name, path_penalty, slashed, stem
from lodestone.functions.text import IDENTIFIER, STOPWORDS, WORD_WITH_DASH, identifier_parts

ALPHA_SYMBOL, ALPHA_TEXT = 0.3, 0.5
COHERENCE, DEFINITION, EMBEDDED, STEM_EXACT, LOCATION, PACKAGE, INSTALLER = 0.2, 3.0, 0.5, 0.75, 2.5, 0.75, 0.35
DECAY = 0.5

# Patterns that classify a query.
SYMBOL_QUERY = re.compile(r"(?:[A-Za-z_]\w*(?:(?:::|\\|->|\.)[A-Za-z_]\w*)+|_\w*|[A-Za-z][A-Za-z0-9]*[A-Z_]\w*|[A-Z][A-Za-z0-9]*)", re.A)
LOCATION_QUERY = re.compile(r"\b(where(?:'s| is)?|entry\s*point|bootstrap|starts?|live[s]?|located|defined|wiring)\b", re.I)
ENTRY_QUERY = re.compile(r"\b(entry\s*point|bootstrap|starts?|wiring|command\s*line)\b", re.I)
INTEGRATION_QUERY = re.compile(r"\b(install|uninstall|hook|agent|configure|setup)\b", re.I)
EMBEDDED_SYMBOL = re.compile(r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b")
# Words that open a definition, stems that say little, stems that hint at an implementation.
DEFINITION_WORDS = ("class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object", "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef")
SQL_DEFINITION_WORDS = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")
GENERIC_STEMS = frozenset("route routes router routing handler middleware channel model models request response utils util server client application dispatch core lib main mod test tests schema config helper helpers engine pipeline plug plugs command commands index".split())
IMPLEMENTATION_STEMS = frozenset("command handler router routing middleware model channel request response dispatch pipeline".split())
# What marks package entries, entry points and installer paths.
PACKAGE_ENTRY = r"^\[package entry\]"
ENTRY_CODE = r"#!/usr/bin|(?:^|\n)\s*(?:async\s+)?function\s+main\s*\(|(?:^|\n)\s*if\s*\(\s*require\.main\s*===\s*module"
INSTALLER_PATH = "(?:^|/)installer(?:/|$)"


def is_symbol_query(query: str) -> bool:
    return bool(SYMBOL_QUERY.fullmatch(query.strip(" \t\r\n")))


def is_location_query(query: str) -> bool:
    return bool(LOCATION_QUERY.search(query))


def is_entry_point_query(query: str) -> bool:
    return bool(ENTRY_QUERY.search(query))


def is_integration_query(query: str) -> bool:
    return bool(INTEGRATION_QUERY.search(query))


def resolve_alpha(query: str, alpha: float | None = None) -> float:
    """Weight of the semantic list: as given (not checked), else by the kind of query."""
    if alpha is not None:
        return alpha
    return ALPHA_SYMBOL if is_symbol_query(query) else ALPHA_TEXT


def improvements_enabled() -> bool:
    """The later boosts are on unless ``LODESTONE_SEARCH_V2`` says 0 or false."""
    return os.environ.get("LODESTONE_SEARCH_V2", "1") not in ("0", "false")


def candidate_count(query: str, k: int) -> int:
    return k * (10 if improvements_enabled() and is_location_query(query) else 5)


def symbol_name(query: str) -> str:
    """The last part after the first kind of separator that occurs."""
    for separator in ("::", "\\", "->", "."):
        if separator in query:
            return query.split(separator)[-1].strip()
    return query.strip()


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def defines(content: Column, names: list[str]) -> Column:
    """Whether a text defines one of the names, by a keyword before it."""
    tests = []
    for name in names:
        after = r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*" + re.sub(r"([^\w\s])", r"\\\1", name) + r"(?:\s|[<({:\[;]|$)"
        words = "|".join(re.sub(" ", r"\\s+", w) for w in DEFINITION_WORDS)
        sql = "|".join(re.sub(" ", r"\\s+", w) for w in SQL_DEFINITION_WORDS)
        tests += [content.rlike(r"(?md)(?:^|\s)(?:" + words + after), content.rlike(r"(?mdi)(?:^|\s)(?:" + sql + after)]
    return any_of(tests)


def stem_matches(path: Column, names: list[str]) -> Column:
    """Whether the file's stem is a name, with or without underscores or one trailing s."""
    s = F.lower(stem(path))
    flat = F.translate(s, "_", "")
    return any_of([s.isin(forms) | flat.isin(forms) | F.regexp_replace(s, "s$", "").isin(forms) | F.regexp_replace(flat, "s$", "").isin(forms) for forms in ([n.lower() for n in names],) if forms])


def definition_tier(path: Column, content: Column, names: list[str]) -> Column:
    """1.5 for a definition in a file named after it, 1 for one elsewhere, else 0."""
    return F.when(defines(content, names), F.when(stem_matches(path, names), 1.5).otherwise(1.0)).otherwise(0.0)


def with_chunks(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scores with path and content, repeated chunks once. Candidates are few, so their side is the one to broadcast."""
    return chunks.select("chunk_id", "file_path", "content").join(scored.select("chunk_id", "score"), "chunk_id").dropDuplicates(["chunk_id"])


def largest(scored: DataFrame) -> float:
    """The best score: one number."""
    return float(scored.agg(F.max("score")).first()[0] or 0.0)


def cohere(scored: DataFrame) -> DataFrame:
    """The best chunk of each file gains a fifth of the best score times the file's share of the largest file sum.

    ``scored`` has ``chunk_id, file_path, score``; equal scores by the smaller id.
    """
    in_file = Window.partitionBy("file_path")
    best = in_file.orderBy(F.round("score", 9).desc(), "chunk_id")
    summed = scored.withColumn("_sum", F.sum("score").over(in_file)).withColumn("_rank", F.row_number().over(best))
    top = summed.agg(F.max("score").alias("_max"), F.max("_sum").alias("_max_sum"))  # one row
    gain = F.when((F.col("_rank") == 1) & (F.col("_max") > 0), F.col("_max") * COHERENCE * F.col("_sum") / F.col("_max_sum")).otherwise(0.0)
    return summed.crossJoin(F.broadcast(top)).withColumn("score", F.col("score") + gain).drop("_sum", "_rank", "_max", "_max_sum")


def injected(chunks: DataFrame, scored: DataFrame, keep: Column, gain: Column) -> DataFrame:
    """Chunks outside ``scored`` for which ``keep`` holds, with ``gain`` as their score if it is not 0; repeated rows once."""
    rows = chunks.where(keep).withColumn("score", gain).where("score <> 0").dropDuplicates(["chunk_id"])
    return rows.join(scored.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "file_path", "content", "score")


def boost_symbol_definitions(scored: DataFrame, chunks: DataFrame, query: str, best: float) -> DataFrame:
    """For a symbol query: definitions gain three times the best score (4.5 in a file of that name) and enter if they are no candidates."""
    names = list(dict.fromkeys([symbol_name(query), query.strip()]))
    gain = definition_tier(F.col("file_path"), F.col("content"), names) * (best * DEFINITION)
    return scored.withColumn("score", F.col("score") + gain).unionByName(injected(chunks, scored, stem_matches(F.col("file_path"), names), gain))


def boost_embedded_symbols(scored: DataFrame, chunks: DataFrame, query: str, best: float) -> DataFrame:
    """The same at half weight for symbols inside a sentence; a stem of four or more characters may be the beginning of the symbol."""
    names = list(dict.fromkeys(EMBEDDED_SYMBOL.findall(query)))
    if not names:
        return scored
    gain = definition_tier(F.col("file_path"), F.col("content"), names) * (best * DEFINITION * EMBEDDED)
    s = F.lower(stem(F.col("file_path")))
    flat = F.translate(s, "_", "")
    lower = [n.lower() for n in names]
    near = any_of([x.isin(lower) | ((F.length(x) >= 4) & any_of([F.lit(n).startswith(x) for n in lower])) for x in (s, flat)])
    return scored.withColumn("score", F.col("score") + gain).unionByName(injected(chunks, scored, near, gain))


def keyword_share(path: Column, query: str) -> Column:
    """Share of the query's keywords that the file's stem or folder holds, exactly or by a prefix of three or more characters."""
    words = sorted({w.lower() for w in re.findall(IDENTIFIER, query) if len(w) > 2 and w.lower() not in STOPWORDS})
    if not words:
        return F.lit(0.0)
    parent = parent_name(path)
    parts = F.array_distinct(F.concat(identifier_parts(stem(path)), F.when(parent.isin("", ".", ".."), F.array().cast("array<string>")).otherwise(identifier_parts(parent))))

    def near(w: Column) -> Column:
        return F.exists(parts, lambda p: ((F.length(p) >= 3) & w.startswith(p)) | ((F.length(w) >= 3) & p.startswith(w)))

    matches = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.array_contains(parts, w) | near(w)))
    return matches / F.lit(float(len(words)))


def boost_stems(scored: DataFrame, query: str, best: float) -> DataFrame:
    """Gain of the best score times the keyword share, from a tenth on."""
    share = keyword_share(F.col("file_path"), query)
    return scored.withColumn("score", F.col("score") + F.when(share >= 0.1, share * best).otherwise(0.0))


def boost_exact_stems(scored: DataFrame, query: str, best: float) -> DataFrame:
    """Gain of 3/4 of the best score, once, for a stem that is a keyword and not generic."""
    words = sorted({w.lower() for w in re.findall(WORD_WITH_DASH, query) if len(w) > 2})
    usable = [w for w in words if w not in GENERIC_STEMS]
    hints = [h for h in IMPLEMENTATION_STEMS if h in query.lower()]
    s = F.lower(stem(F.col("file_path")))
    prefer = bool(hints) and bool(scored.where(s.isin(hints)).take(1))
    # where an implementation is asked for by its stem, an equal stem counts only if it hints at one
    match = any_of([((s == w) | (bare(s) == re.sub("[-_]", "", w))) & ~((s == w) & F.lit(prefer and w not in IMPLEMENTATION_STEMS)) for w in usable])
    return scored.withColumn("score", F.col("score") + F.when(match, best * STEM_EXACT).otherwise(0.0))


def stem_in_query(path: Column, query: str) -> Column:
    """Whether a query word is the stem; a part of a dashed word does not count, another spelling does."""
    words = [w.lower() for w in re.findall(WORD_WITH_DASH, query)]
    if not words:
        return F.lit(False)
    s = F.lower(stem(path))
    parts = sorted({p for w in words if "-" in w for p in w.split("-")})
    spelled = bare(s).isin([re.sub("[-_]", "", w) for w in words])
    return s.isin(words) | (~(s.isin(parts) if parts else F.lit(False)) & spelled)


def boost_locations(scored: DataFrame, chunks: DataFrame, query: str, best: float) -> DataFrame:
    """For a location query: package entries and entry points of all chunks gain and enter."""
    if not is_location_query(query):
        return scored
    entry = is_entry_point_query(query)
    package = F.col("content").rlike(PACKAGE_ENTRY)
    code = F.col("content").rlike(ENTRY_CODE) & (F.lit(True) if entry else stem_in_query(F.col("file_path"), query))
    gain = F.when(package, best * (LOCATION if entry else PACKAGE)).when(code, best * LOCATION).otherwise(0.0)
    return scored.withColumn("score", F.col("score") + gain).unionByName(injected(chunks, scored, package | code, gain))


def penalize_installer(scored: DataFrame, query: str) -> DataFrame:
    """Installer paths keep 35 % for location queries that are not about integration."""
    if not is_location_query(query) or is_integration_query(query):
        return scored
    return scored.withColumn("score", F.col("score") * F.when(slashed(F.col("file_path")).rlike(INSTALLER_PATH), INSTALLER).otherwise(1.0))


def boosted(scored: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """All boosts in order; the best score is taken after file coherence and holds for all others."""
    scored = cohere(scored)
    best = largest(scored)
    if is_symbol_query(query):
        return boost_symbol_definitions(scored, chunks, query, best)
    scored = boost_embedded_symbols(boost_stems(scored, query, best), chunks, query, best)
    if improvements_enabled():
        scored = penalize_installer(boost_locations(boost_exact_stems(scored, query, best), chunks, query, best), query)
    return scored


def saturated(scored: DataFrame, k: int, penalize: bool = True) -> DataFrame:
    """The ``k`` best after path penalties, each further chunk of a file at half the weight of the one before."""
    rows = scored.withColumn("score", F.col("score") * path_penalty(F.col("file_path"))) if penalize else scored
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy(F.round("score", 9).desc(), "chunk_id"))
    rows = rows.withColumn("_n", nth).withColumn("score", F.col("score") * F.pow(F.lit(DECAY), F.col("_n") - 1)).drop("_n")
    return rows.orderBy(F.round("score", 9).desc(), "chunk_id").limit(k)


def best_per_file(results: DataFrame) -> DataFrame:
    """The best row of each file."""
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy(F.round("score", 9).desc(), "chunk_id"))
    return results.withColumn("_n", nth).where("_n = 1").drop("_n")


def relevance(results: DataFrame) -> DataFrame:
    """``relevance``: score as a rounded percentage of the best score, 0 without a positive score."""
    top = F.broadcast(results.agg(F.max("score").alias("_max")))  # one row
    pct = F.when(F.col("_max") > 0, F.floor(F.col("score") / F.col("_max") * 100 + 0.5)).otherwise(0).cast("int")
    return results.crossJoin(top).withColumn("relevance", pct).drop("_max")
