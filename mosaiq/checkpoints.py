"""Cutting lineage with files in the folder that the cluster names in spark.checkpoint.dir, and dealing out small tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which the driver and all executors share.

    Where that is unset a local session gets a temporary one; a cluster, whose
    executors couldn't all reach it, an error.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to four tasks for each core, where rows of few bytes are much work; Spark would read such a table in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: With it Spark deletes an execution's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared checkpoint folder from then on; the shuffle files that it took are deleted."""
    session = df.sparkSession
    shared_folder(session)
    before = session.conf.get(CLEANUP, None)
    session.conf.set(CLEANUP, "true")
    try:
        # what a plan does about its files is settled when it is made
        return df.select("*").checkpoint()
    finally:
        if before is None:
            session.conf.unset(CLEANUP)
        else:
            session.conf.set(CLEANUP, before)
