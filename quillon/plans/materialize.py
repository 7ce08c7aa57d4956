"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names its shared folder in `spark.checkpoint.dir`. Where that is unset, a temporary folder is made
    on a single machine; on a cluster that is an error, as executors can't share such a folder.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = path or tempfile.mkdtemp(prefix="quillon-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_all(*dfs: DataFrame) -> list[DataFrame]:
    return [materialize(df) for df in dfs]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over as many partitions as the session shuffles into, and at least twice its cores.

    For steps that compute much per byte: by their size alone, adaptive execution would put them into few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def widen(df: DataFrame) -> DataFrame:
    """`df` over all cores of the session if it comes straight from files or a checkpoint in fewer partitions than these.

    For steps that compute much per byte on inputs of a few files. Inputs with enough partitions, as all large ones
    have, stay where they are and aren't shuffled; so do plans that shuffle anyway.
    """
    sc = df.sparkSession.sparkContext
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(2 * sc.defaultParallelism) if df._jdf.queryExecution().toRdd().getNumPartitions() < sc.defaultParallelism else df
