"""The folder that the driver and all executors share, and rows kept in it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a folder made here in local mode, else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows kept in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where their files give fewer partitions than there are cores; a large table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
