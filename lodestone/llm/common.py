"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import release, shared_dir, written

__all__ = ["label_key", "release", "shared_dir", "table", "text_batches", "tokenizer_folder", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_key(column: Column) -> Column:
    """Spelling-independent form of a label: trimmed, lower case, one kind of joiner."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def text_batches(batches: Iterator, max_bytes: int = 8 << 20) -> Iterator:
    """Cut Arrow record batches so that none holds much more than ``max_bytes``.

    A batch is cut by rows only; a row longer than the limit stays whole.
    """
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        rows = max(1, batch.num_rows * max_bytes // batch.nbytes)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tokenizer_folder() -> str:
    """Folder of the public tokenizers' files; ``LODESTONE_TOKENIZERS`` overrides it."""
    return os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
