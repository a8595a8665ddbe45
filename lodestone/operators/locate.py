"""Exact literal search over chunks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import matches_any_glob


def identifier_words(literal: str) -> list[str]:
    """Words of an identifier: cut at separators, before a capital after a small letter or digit, and before the last capital of an acronym."""
    text = re.sub(r"[_\-\s]+", " ", literal)
    text = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=\d)(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return text.split()


def identifier_variants(literal: str) -> list[str]:
    """camelCase, PascalCase, snake_case, kebab-case and CONSTANT_CASE."""
    words = [w.lower() for w in identifier_words(literal)]
    if not words:
        return []
    caps = [w[:1].upper() + w[1:] for w in words]
    return [words[0] + "".join(caps[1:]), "".join(caps), "_".join(words), "-".join(words), "_".join(words).upper()]


def needles_of(literals: str | Sequence[str], variants: bool = False) -> list[str]:
    """Distinct non-empty needles in order, each followed by its spellings if wanted."""
    given = [literals] if isinstance(literals, str) else list(literals)
    out: dict[str, None] = {}
    for literal in filter(None, given):
        for n in [literal, *(identifier_variants(literal) if variants else [])]:
            out.setdefault(n)
    return list(out)


def holds_any(text: Column, needles: list[str], ignore_case: bool = False) -> Column:
    hay = F.lower(text) if ignore_case else text
    return reduce(lambda a, b: a | b, [hay.contains(F.lower(F.lit(n)) if ignore_case else F.lit(n)) for n in needles], F.lit(False))


def locate(chunks: DataFrame, literals: str | Sequence[str], ignore_case: bool = False, variants: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (), context: int = 0) -> DataFrame:
    """Every distinct (file, line) that holds a needle: ``chunk_id, file_path, line, text, context, context_start_line``.

    Chunks are tested whole before their lines are taken apart. A line that
    several chunks hold counts once, for the smallest chunk id. ``context`` lines
    around the hit stay within the chunk; without context both columns are null.
    No needles give no row; chunks without content or path hold nothing.
    """
    needles = needles_of(literals, variants)
    rows = chunks.where("content is not null and file_path is not null")
    if include:
        rows = rows.where(matches_any_glob(F.col("file_path"), list(include)))
    if exclude:
        rows = rows.where(~matches_any_glob(F.col("file_path"), list(exclude)))
    rows = rows.where(holds_any(F.col("content"), needles, ignore_case))
    split = rows.select("chunk_id", "file_path", "start_line", F.split("content", "\n").alias("lines"))
    context = max(0, context)
    hits = split.select("chunk_id", "file_path", "start_line", *(["lines"] if context else []), F.posexplode("lines").alias("i", "text")).where(holds_any(F.col("text"), needles, ignore_case))
    first = F.greatest(F.col("i") - context, F.lit(0))
    around = F.slice("lines", first + 1, F.col("i") + context - first + 1) if context else F.lit(None).cast("array<string>")
    start = (F.col("start_line") + first).cast("int") if context else F.lit(None).cast("int")
    found = hits.select("chunk_id", "file_path", (F.col("start_line") + F.col("i")).cast("int").alias("line"), "text", around.alias("context"), start.alias("context_start_line"))
    nth = F.row_number().over(Window.partitionBy("file_path", "line").orderBy("chunk_id"))
    return found.withColumn("_n", nth).where("_n = 1").drop("_n")


def summary(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """One row ``n, files, truncated``; the totals do not mind the limit."""
    cut = F.lit(False) if limit is None else F.count(F.lit(1)) > max(1, limit)
    return hits.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"), cut.alias("truncated"))


def shown(hits: DataFrame, mode: str = "lines", limit: int | None = None) -> DataFrame:
    """Hits in corpus order: with text for ``lines``, without for ``locations``, none for ``count``; at least one if limited."""
    if mode == "count":
        return hits.select("file_path", "line").where(F.lit(False))
    columns = ["file_path", "line"] + (["text", "context", "context_start_line"] if mode == "lines" else [])
    ordered = hits.orderBy("chunk_id", "line").select(*columns)
    return ordered if limit is None else ordered.limit(max(1, limit))


def compact(hits: DataFrame) -> DataFrame:
    """One JSON object per hit with short keys; absent parts are left out."""
    return hits.select(F.to_json(F.struct(F.col("file_path").alias("f"), F.col("line").alias("l"), F.col("text").alias("t"), F.col("context").alias("ctx"), F.col("context_start_line").alias("ctx_l"))).alias("hit"))
