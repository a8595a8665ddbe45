"""Persisted index bundles: tables in a folder, their completeness and validity, and a session cache."""

from __future__ import annotations

import json
import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone import __version__
from lodestone.sources.scan import is_remote, source_key

if TYPE_CHECKING:
    from lodestone.plans.index import Index

TABLES = ("chunks", "postings", "lengths", "vectors", "files")
SESSION_ENTRIES = 10


def cache_epoch() -> str:
    """Major version from 1 on, else the whole version: bundles of another epoch are not read."""
    major = __version__.split(".")[0]
    return major if major != "0" else __version__


def cache_home() -> str:
    return os.environ.get("LODESTONE_CACHE") or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "lodestone")


def bundle_path(source: str, ref: str | None = None) -> str:
    return os.path.join(cache_home(), source_key(source, ref), "index")


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path, so that bundles may lie in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def missing_parts(spark: SparkSession, path: str) -> list[str]:
    """Tables without a finished write, and the metadata if there is none."""
    return [t for t in (*TABLES, "metadata") if not exists(spark, f"{path}/{t}/_SUCCESS")]


def save(path: str, tables: dict[str, DataFrame], metadata: dict) -> None:
    """Write all tables, metadata last, so that an interrupted write is seen as incomplete.

    Postings are sorted by term and chunks by file, which lets searches skip
    row groups.
    """
    spark = tables["chunks"].sparkSession
    remove(spark, f"{path}/metadata")
    order = {"postings": ["term", "chunk_id"], "chunks": ["file_path", "start_line", "chunk_id"], "vectors": ["chunk_id"], "lengths": ["chunk_id"], "files": ["file_path"]}
    for name in TABLES:
        df = tables[name]
        df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]).write.mode("overwrite").parquet(f"{path}/{name}")
    record = {"index_epoch": cache_epoch(), "saved_at_ms": int(time.time() * 1000), **metadata}
    spark.createDataFrame([Row(metadata=json.dumps(record, sort_keys=True))], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    if lacking := missing_parts(spark, path):
        raise FileNotFoundError(f"{path} lacks {', '.join(lacking)}")
    record = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}, record


def invalid_because(metadata: dict, model: str, dimensions: int, storage: str, content: Sequence[str]) -> list[str]:
    """Reasons why a bundle does not fit what is wanted."""
    wanted = {"index_epoch": cache_epoch(), "embedding_model": model, "embedding_dimensions": dimensions, "vector_storage": storage}
    reasons = [k for k, v in wanted.items() if metadata.get(k) != v]
    return reasons + ["content_type"] * (set(metadata.get("content_type", [])) != set(content))


def validated(spark: SparkSession, source: str, model: str, dimensions: int, storage: str, content: Sequence[str], listing: DataFrame | None = None) -> str | None:
    """The path of a complete bundle that fits and whose files did not change since; one of another epoch is removed.

    ``listing(file_path, mtime_ms, size_bytes)`` is the source as it is now.
    """
    from lodestone.operators.incremental import changed_files

    path = bundle_path(source)
    if missing_parts(spark, path):
        return None
    tables, metadata = load(spark, path)
    reasons = invalid_because(metadata, model, dimensions, storage, content)
    if "index_epoch" in reasons:
        remove(spark, path)
    if reasons or (not is_remote(source) and not os.path.exists(source)):
        return None
    if listing is not None and changed_files(tables["files"], listing).take(1):
        return None
    return path


def clear(spark: SparkSession, source: str) -> None:
    remove(spark, bundle_path(source))


class SessionCache:
    """At most ten open indexes, the oldest leaves first; a failed build is not kept.

    Requests for one source at a time: those that come while it is built wait for
    that build; other sources are not held up.
    """

    def __init__(self, entries: int = SESSION_ENTRIES):
        self.entries = entries
        self._open: OrderedDict[str, Index] = OrderedDict()
        self._lock, self._building = threading.Lock(), {}

    def get(self, source: str, build: Callable[[], Index]) -> Index:
        key = source_key(source)
        with self._lock:
            turn = self._building.setdefault(key, threading.Lock())
        with turn:
            with self._lock:
                if key in self._open:
                    return self._open[key]
            index = build()
            with self._lock:
                gone = [self._open.popitem(last=False)[1] for _ in range(max(0, len(self._open) - self.entries + 1))]
                self._open[key] = index
        for old in gone:
            old.close()
        return index


def read_vector_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(chunk_id, codes, scale)`` or ``(chunk_id, embedding)`` of a small binary vector folder.

    ``meta.json`` names count and dimensions; ``codes.bin`` and ``scales.bin``
    (little-endian float32) or ``vectors.bin`` hold the rows. The files are read
    on the driver, which is what that format is made for; ids are positions from 0.
    """
    with open(os.path.join(folder, "meta.json")) as f:
        width = int(json.load(f)["dimensions"])
    codes = os.path.join(folder, "codes.bin")
    if os.path.exists(codes):
        c = np.fromfile(codes, np.int8).reshape(-1, width)
        s = np.fromfile(os.path.join(folder, "scales.bin"), "<f4")
        return spark.createDataFrame([(i, [int(x) for x in c[i]], float(s[i])) for i in range(len(c))], "chunk_id bigint, codes array<tinyint>, scale float")
    v = np.fromfile(os.path.join(folder, "vectors.bin"), "<f4").reshape(-1, width)
    return spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(len(v))], "chunk_id bigint, embedding array<float>")


def write_vector_files(vectors: DataFrame, folder: str, most_rows: int = 1_000_000) -> None:
    """The same folder from int8 or float vectors of at most ``most_rows`` rows, ordered by id."""
    if vectors.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too many rows for single files; write Parquet instead")
    os.makedirs(folder, exist_ok=True)
    rows = vectors.orderBy("chunk_id").collect()
    quantized = "codes" in vectors.columns
    width = len(rows[0]["codes" if quantized else "embedding"]) if rows else 0
    if quantized:
        np.array([r["codes"] for r in rows], np.int8).tofile(os.path.join(folder, "codes.bin"))
        np.array([r["scale"] for r in rows], "<f4").tofile(os.path.join(folder, "scales.bin"))
    else:
        np.array([r["embedding"] for r in rows], "<f4").tofile(os.path.join(folder, "vectors.bin"))
    with open(os.path.join(folder, "meta.json"), "w") as f:
        json.dump({"count": len(rows), "dimensions": width}, f)


def write_postings_json(tokens: DataFrame, path: str) -> None:
    """Token lists per chunk as JSON lines (the older form of a keyword index)."""
    tokens.select(F.to_json(F.struct("chunk_id", "tokens")).alias("value")).write.mode("overwrite").text(path)


def read_postings_json(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_id, tokens)`` of such files; malformed lines are left out."""
    parsed = spark.read.text(path).select(F.from_json("value", "chunk_id bigint, tokens array<string>").alias("r")).select("r.*")
    return parsed.where("chunk_id is not null")
