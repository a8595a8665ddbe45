"""The driver's tables as inputs of the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they are, repeated rows included, with the repository as the first folder of the path.

    For operators whose results are narrow: these drop repeats afterwards, which
    moves a few columns instead of the texts.
    """
    return table(spark, sf_dir, "chunks").select("chunk_id", F.concat_ws("/", "repo", "file_path").alias("file_path"), "start_line", "end_line", "language", "content")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each chunk once.

    Moves whatever columns are selected from it, so it is meant for narrow ones; operators
    that read the content take ``corpus_rows`` and drop repeats afterwards.
    """
    return corpus_rows(spark, sf_dir).dropDuplicates(["chunk_id"])


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their own: path ``source/lang/doc_<id>.txt``."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return d.select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("lang").alias("language"), F.col("text").alias("content"))


def int8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, codes, scale)`` of rows with 256 codes, each chunk once."""
    return table(spark, sf_dir, "vectors").where("size(codes) = 256").dropDuplicates(["chunk_id"])


def float_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, embedding, label)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
