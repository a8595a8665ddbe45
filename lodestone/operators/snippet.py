"""Query-centred snippets of chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOPWORDS, WORD_WITH_DASH, tokens_of

LINES, LEAST_LINES = 15, 3


def match_terms(query: str) -> list[str]:
    """Tokens and words of three or more characters that are no stopwords."""
    words = {*tokens_of(query), *(w.lower() for w in re.findall(WORD_WITH_DASH, query))}
    return sorted(w for w in words if len(w) >= 3 and w not in STOPWORDS)


def snippets(chunks: DataFrame, query: str, lines: int = LINES) -> DataFrame:
    """Each chunk cut to ``lines`` around the first line that holds most query terms.

    Adds ``anchor_line, truncated, full_start_line, full_end_line`` and replaces
    content and lines. Without any match the first line is the anchor; null
    content counts as empty. At least LEAST_LINES lines are kept on each side.
    """
    lines = max(LEAST_LINES, lines)
    terms = match_terms(query)
    all_lines = F.split(F.coalesce("content", F.lit("")), "\n")

    def score(line):
        low = F.lower(line)
        return sum((low.contains(t).cast("int") for t in terms), F.lit(0))

    scored = chunks.withColumn("_lines", all_lines).withColumn("_scores", F.transform("_lines", score))
    at = scored.withColumn("_at", F.array_position("_scores", F.array_max("_scores")).cast("int") - 1)
    first = F.greatest(F.col("_at") - lines, F.lit(0))
    last = F.least(F.col("_at") + lines, F.size("_lines") - 1)
    cut = (first > 0) | (last < F.size("_lines") - 1)
    return at.select(
        *[c for c in chunks.columns if c not in ("content", "start_line", "end_line")],
        F.when(cut, F.array_join(F.slice("_lines", first + 1, last - first + 1), "\n")).otherwise(F.col("content")).alias("content"),
        F.when(cut, F.col("start_line") + first).otherwise(F.col("start_line")).cast("int").alias("start_line"),
        F.when(cut, F.col("start_line") + last).otherwise(F.col("end_line")).cast("int").alias("end_line"),
        (F.col("start_line") + F.col("_at")).cast("int").alias("anchor_line"),
        cut.alias("truncated"),
        F.col("start_line").alias("full_start_line"),
        F.col("end_line").alias("full_end_line"),
    )
