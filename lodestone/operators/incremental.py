"""Incremental maintenance of chunks, vectors and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import written


#: Bits of a row number within its partition in ``monotonically_increasing_id``.
_ROW_BITS = 33


def next_ids(rows: DataFrame, order: list[str], after: int) -> DataFrame:
    """``chunk_id`` from ``after + 1`` on in the order of ``order``, without gathering the rows in one task.

    Rows are spread by range, sorted within their partitions and written once with
    partition and place; ids are then the place plus the sizes of the partitions
    before (one number per partition). As the ids come from the written rows, every
    later reading gives the same ones, whatever the planner does. Equal rows of
    ``order`` are numbered in any order; nulls come first; no rows give none.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumn("_p", F.shiftright("_m", _ROW_BITS))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    place = F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = placed.join(F.broadcast(before), "_p").withColumn("chunk_id", F.lit(after + 1).cast("bigint") + F.col("_before") + place)
    return numbered.drop("_p", "_m", "_before")


def apply_changes(chunks: DataFrame, changed: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks after a change: rows of ``changed(file_path)`` go, ``new_chunks`` come with new ids.

    A deleted file is a changed path without new chunks. Kept rows keep their
    ids, so vectors and postings of unchanged chunks stay as they are.
    """
    kept = chunks.join(changed.select("file_path").distinct(), "file_path", "left_anti").select(*chunks.columns)
    top = chunks.agg(F.max("chunk_id")).first()[0]
    added = next_ids(new_chunks.drop("chunk_id"), ["file_path", "start_line"], int(top or 0))
    return kept.unionByName(added.select(*chunks.columns))


def keep_for(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of an index table whose chunk is still there."""
    return rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(*rows.columns)


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(file_path, change)`` between two listings ``(file_path, mtime_ms, size_bytes)``: added, removed or modified."""
    a = before.select("file_path", F.struct("mtime_ms", "size_bytes").alias("was")).withColumn("_a", F.lit(True))
    b = now.select("file_path", F.struct("mtime_ms", "size_bytes").alias("is")).withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "modified")
    return a.join(b, "file_path", "full").select("file_path", change.alias("change")).where("change is not null")
