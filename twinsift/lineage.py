"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="twinsift-ck-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; a lost executor never forces a recomputation beyond it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage: only then does Spark drop broadcasts and shuffle files of plans that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, replaces: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared checkpoint folder, read back, and its path.

    ``replaces`` is the path of a table that only ``df`` was made from; it goes once ``df`` is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces:
        old = spark._jvm.org.apache.hadoop.fs.Path(replaces)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(path), path
