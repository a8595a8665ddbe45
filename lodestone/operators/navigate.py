"""Chunks of a file, the chunk at a line, neighbours, related chunks, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import under_any


def chunk_key(path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", path, start, end)


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start, F.lit("-"), end)


def selection(languages: Sequence[str] = (), paths: Sequence[str] = ()) -> Column | None:
    """Rows in one of the languages and below one of the paths; None without filters. A filter that nothing meets selects nothing."""
    tests = []
    if languages:
        tests.append(F.coalesce(F.col("language").isin(list(languages)), F.lit(False)))
    if paths:
        tests.append(F.coalesce(under_any(F.col("file_path"), list(paths)), F.lit(False)))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def chunks_of_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).orderBy("start_line", "chunk_id")


def resolve(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """The chunk that covers a line, one that goes on after it before one that ends on it; no row if none does."""
    covers = chunks.where((F.col("file_path") == path) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
    return covers.orderBy((F.col("end_line") == line).cast("int"), "chunk_id").limit(1)


def resolve_many(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """``places(file_path, line)`` with the covering ``chunk_id``, null where no chunk does.

    A range join on the file; repeated places count once.
    """
    asked = places.select("file_path", "line").distinct()
    ranges = chunks.select("file_path", "start_line", "end_line", "chunk_id")
    inside = asked.alias("p").join(ranges.alias("c"), (F.col("p.file_path") == F.col("c.file_path")) & F.col("p.line").between(F.col("c.start_line"), F.col("c.end_line")))
    best = inside.groupBy("p.file_path", "p.line").agg(F.min_by("c.chunk_id", F.struct((F.col("c.end_line") == F.col("p.line")).cast("int"), F.col("c.chunk_id"))).alias("chunk_id"))
    return asked.join(best, ["file_path", "line"], "left")


def expand(chunks: DataFrame, path: str, line: int, before: int = 1, after: int = 1) -> DataFrame:
    """The covering chunk with its neighbours in the file, ``is_anchor`` set on it."""
    in_order = Window.partitionBy("file_path").orderBy("start_line", "chunk_id")
    numbered = chunks.where(F.col("file_path") == path).withColumn("_n", F.row_number().over(in_order))
    anchor = F.broadcast(resolve(numbered, path, line).select(F.col("_n").alias("_a")))  # at most one row
    near = numbered.join(anchor, F.col("_n").between(F.col("_a") - before, F.col("_a") + after))
    return near.withColumn("is_anchor", F.col("_n") == F.col("_a")).drop("_n", "_a").orderBy("start_line", "chunk_id")
