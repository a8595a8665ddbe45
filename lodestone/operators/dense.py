"""Vectors: quantisation, exact nearest neighbours, windows and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bound

WINDOW_CHARS, OVERLAP_CHARS, LEAST_STEP = 1300, 120, 64


def quantize(vector: Column) -> Column:
    """``struct(codes, scale)``: int8 codes and the float scale; a zero or empty vector has scale 1 and zero codes."""
    zero, top = F.lit(0.0).cast("float"), F.lit(127.0).cast("float")
    largest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x))), zero).cast("float")
    inverse = F.when(largest > 0, (top / largest).cast("float")).otherwise(zero)

    def codes(inverse: Column) -> Column:
        def code(x: Column) -> Column:
            scaled = (x.cast("float") * inverse).cast("float").cast("double")
            return F.greatest(F.lit(-127), F.least(F.lit(127), F.round(scaled).cast("int"))).cast("tinyint")

        return F.transform(vector, code)

    return F.struct(bound(inverse, codes).alias("codes"), F.when(largest > 0, (largest / top).cast("float")).otherwise(F.lit(1.0).cast("float")).alias("scale"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(v)
    inverse = F.when(length > 0, 1.0 / length).otherwise(0.0)
    return bound(F.struct(v.alias("v"), inverse.alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") * s["n"]))


def dequantize(codes: Column, scale: Column) -> Column:
    """Codes times scale, at length one."""
    return bound(F.transform(codes, lambda c: c.cast("double") * scale.cast("double")), unit)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, distance: Column | None = None, selected: Column | None = None, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """``(chunk_id, distance)`` of the ``k`` nearest rows; equal distances by the smaller id.

    One pass with a bounded heap per task. ``k`` beyond the number of rows is
    clipped, ``k`` below one is an error. Rows of another width than the query,
    null vectors and rows that ``selected`` does not hold true for are skipped.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    literal = F.array(*[F.lit(float(x)) for x in query])
    d = 1 - dot(F.col(vector), literal) if distance is None else distance
    rows = vectors.where(F.size(vector) == len(query))
    if selected is not None:
        rows = rows.where(selected)
    return rows.select(F.col(key).alias("chunk_id"), d.alias("distance")).orderBy(F.round("distance", 9), "chunk_id").limit(k)


def nearest_int8(vectors: DataFrame, query: Sequence[float], k: int, selected: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """Nearest neighbours over ``(codes, scale)`` rows: integer dot product times both scales."""
    codes, scale = quantized_literal(query)
    literal = F.array(*[F.lit(c) for c in codes]).cast("array<int>")
    whole = F.aggregate(F.zip_with(F.col("codes"), literal, lambda x, y: x.cast("int") * y), F.lit(0), lambda s, x: s + x)
    return nearest(vectors, query, k, 1 - whole * F.col("scale").cast("double") * F.lit(scale), selected, "codes", key)


def quantized_literal(query: Sequence[float]) -> tuple[list[int], float]:
    """Codes and scale of the query vector."""
    import numpy as np

    v = np.asarray(query, dtype=np.float32)
    largest = float(np.abs(v).max()) if len(v) else 0.0
    if largest == 0:
        return [0] * len(v), 1.0
    scaled = (v * np.float32(127.0 / np.float32(largest))).astype(np.float32)
    codes = np.clip(np.trunc(scaled + np.copysign(np.float32(0.5), scaled)), -127, 127)
    return [int(c) for c in codes], float(largest) / 127.0


def windows(text: Column, size: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Overlapping windows of a text by characters; a text within ``size`` is one window.

    A window ends at a character, never inside one; windows stop once one
    reaches the end of the text.
    """
    step = max(size - overlap, LEAST_STEP)
    n = F.char_length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))


def mean_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean vector per key at length one, as ``vector``.

    Sums are pre-aggregated by (key, position), so no group of vectors is ever
    gathered in one task; the last step holds one value per position.
    """
    flat = rows.select(*keys, F.posexplode(vector).alias("pos", "value"))
    means = flat.groupBy(*keys, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    packed = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias(vector))
    return packed.withColumn(vector, unit(F.col(vector)))


def as_score(distances: DataFrame) -> DataFrame:
    """Distance to score; negative scores are kept."""
    return distances.select("chunk_id", (1 - F.col("distance")).alias("score"))


#: Queries that are held against all rows at a time.
QUERY_BLOCK = 4096


def nearest_of_many(vectors: DataFrame, every: int, k: int, related: bool = False) -> DataFrame:
    """``(query_id, chunk_id, distance)``: the ``k`` nearest rows of ``(chunk_id, codes, scale)`` to each row whose id is divisible by ``every``.

    Every row is compared with every query, by blocks of queries in one pass over
    the rows each. float32 products of int8 codes are exact up to 1,040 codes. A task
    only leaves out rows that are farther than ``k`` it has seen. ``related``
    takes queries with a ``language`` and rows of the same, without the query itself.
    """
    import numpy as np
    import pyarrow as pa

    rows = vectors.select("chunk_id", "codes", F.col("scale").cast("double").alias("scale"), F.col("language") if related else F.lit("").alias("language"))
    asked = rows.where((F.col("chunk_id") % every == 0) & F.col("language").isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
        ids = np.array([r["chunk_id"] for r in block], np.int64)
        codes = np.array([r["codes"] for r in block], np.float32).reshape(len(block), -1)
        scales = np.array([r["scale"] for r in block], np.float64)
        languages = np.array([r["language"] for r in block], object)
        held = vectors.sparkSession.sparkContext.broadcast((ids, codes, scales, languages))

        def run(batches, held=held):
            ids, codes, scales, languages = held.value
            best = np.full((len(ids), k), np.inf)
            for whole in batches:
                for at in range(0, whole.num_rows if len(ids) else 0, 1024):
                    batch = whole.slice(at, 1024)
                    mine = batch.column(0).to_numpy(zero_copy_only=False)
                    matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1).astype(np.float32)
                    far = 1 - (codes @ matrix.T).astype(np.float64) * batch.column(2).to_numpy(zero_copy_only=False) * scales[:, None]
                    if related:
                        other = np.array(batch.column(3).to_pylist(), object)
                        far[(languages[:, None] != other) | (ids[:, None] == mine)] = np.inf
                    best = np.partition(np.concatenate([best, far], axis=1), k - 1, axis=1)[:, :k]
                    # distances that are equal to nine digits are left to the order by ids
                    q, r = np.nonzero((far <= best.max(axis=1)[:, None] + 2e-9) & np.isfinite(far))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(mine[r].astype(np.int64)), pa.array(far[q, r])], names=["query_id", "chunk_id", "distance"])

        part = rows.mapInArrow(run, "query_id bigint, chunk_id bigint, distance double")
        out = part if out is None else out.unionByName(part)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "chunk_id"))
    return out.withColumn("_n", nth).where(F.col("_n") <= k).drop("_n")
