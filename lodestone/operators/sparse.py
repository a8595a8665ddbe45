"""Keyword retrieval: inverted index, BM25 scores, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import slashed, stem
from lodestone.functions.text import tokens, tokens_of

K1, B = 1.5, 0.75


def enriched(content: Column, path: Column) -> Column:
    """Content, the file's stem twice, and its last three folders."""
    parts = F.split(slashed(path), "/")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("", ".", ".."))
    last = F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), 3)
    return F.concat_ws(" ", F.coalesce(content, F.lit("")), stem(slashed(path)), stem(slashed(path)), F.array_join(last, " "))


def chunk_tokens(chunks: DataFrame, enrich: bool = True) -> DataFrame:
    """``(chunk_id, tokens)``; a chunk without tokens keeps its row."""
    text = enriched(F.col("content"), F.col("file_path")) if enrich else F.col("content")
    return chunks.select("chunk_id", tokens(text).alias("tokens"))


def postings(chunk_tokens: DataFrame) -> DataFrame:
    """``(term, chunk_id, tf)``: how often each chunk holds each term.

    Tokens are numbered in sorted order, where a term's occurrences are neighbours: its
    count is the span of its numbers. A chunk that occurs more than once (identical
    rows) gives the same numbers again and so counts once, without an exchange of texts.
    """
    placed = chunk_tokens.select("chunk_id", F.posexplode(F.sort_array("tokens")).alias("at", "term"))
    return placed.groupBy("term", "chunk_id").agg((F.max("at") - F.min("at") + 1).cast("int").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """``(term, df)``: chunks that hold a term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(chunk_tokens: DataFrame) -> DataFrame:
    """``(chunk_id, dl)``: tokens of every chunk, those without any included; repeated rows count once."""
    return chunk_tokens.select("chunk_id", F.size("tokens").alias("dl")).groupBy("chunk_id").agg(F.max("dl").alias("dl"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """One row ``(n_chunks, avg_len, max_len)``."""
    return lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_len"), F.max("dl").alias("max_len"))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order."""
    return list(dict.fromkeys(tokens_of(query)))


def _weight(tf: Column, dl: Column, avg: Column, idf: Column) -> Column:
    norm = F.when(avg > 0, avg).otherwise(1.0)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / norm))


def _idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def scan_scores(chunks: DataFrame, query: str, enrich: bool = True, selected: Column | None = None) -> DataFrame:
    """``(chunk_id, score)`` of chunks that hold a query term, straight from the chunks.

    One pass counts each query term per chunk; nothing is exploded. The narrow
    counts are exchanged by chunk once and serve both the one-row statistics and
    the scores; rows that occur more than once under an id (identical) count once.
    Statistics cover all chunks, ``selected`` restricts the result only. Terms no
    chunk holds add nothing; a query without terms gives no row.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).where(F.lit(False))
    text = enriched(F.col("content"), F.col("file_path")) if enrich else F.col("content")
    chosen = [] if selected is None else [F.coalesce(selected, F.lit(False)).alias("sel")]
    rows = chunks.select("chunk_id", *chosen, tokens(text).alias("t"))
    each = rows.select("chunk_id", *[c for c in rows.columns if c == "sel"], F.size("t").alias("dl"), *[F.size(F.filter("t", _is(w))).alias(f"tf{i}") for i, w in enumerate(terms)])
    counted = each.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in each.columns[1:]])
    # both branches read the same columns of the exchanged counts, so it is made once
    n_selected = F.count(F.when(F.col("sel"), 1) if chosen else F.lit(1))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), n_selected.alias("n_sel"), F.avg("dl").alias("avg"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    score = sum((F.when(F.col(f"tf{i}") > 0, _weight(F.col(f"tf{i}"), F.col("dl"), F.col("avg"), _idf(F.col("n"), F.col(f"df{i}")))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    hit = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    # the statistics are one row
    kept = counted.where(hit & F.col("sel")) if chosen else counted.where(hit)
    return kept.crossJoin(F.broadcast(stats)).where("n_sel > 0").select("chunk_id", score.alias("score")).where("score > 0")


def index_scores(postings: DataFrame, lengths: DataFrame, query: str, selected: DataFrame | None = None) -> DataFrame:
    """``(chunk_id, score)`` from a built index.

    The terms are literals, so the filter reaches the scan of the postings and,
    where these are sorted by term, skips all other row groups.
    """
    terms = query_terms(query)
    hits = postings.where(F.col("term").isin(terms)) if terms else postings.where(F.lit(False))
    df = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # as many rows as the query has terms
    stats = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg")))  # one row
    rows = hits.join(lengths, "chunk_id").join(df, "term").crossJoin(stats)
    if selected is not None:
        rows = rows.join(selected.select("chunk_id").distinct(), "chunk_id", "left_semi")
    scored = rows.groupBy("chunk_id").agg(F.sum(_weight(F.col("tf"), F.col("dl"), F.col("avg"), _idf(F.col("n"), F.col("df")))).alias("score"))
    return scored.where("score > 0")


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows; equal scores by the smaller chunk id. Scores are compared at nine decimals."""
    return scores.orderBy(F.round(score, 9).desc(), "chunk_id").limit(max(0, k))
