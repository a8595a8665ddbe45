"""Tables written into the folder that all executors share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (as in tests on one machine) a folder of
    this machine is made and set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = java_dir.get() if java_dir.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


@atexit.register
def _tidy() -> None:
    """Tables on a file system of this machine go with the process; elsewhere ``release`` removes them."""
    for path in _WRITTEN:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The copy survives the loss of any executor, is columnar (later stages read
    only the columns they need) and splits by size. It stays until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the tables that ``written`` made in this process; results that read them end with it."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
