"""Reading inputs and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from gradus.sources.parallel import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with work for all cores even if it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's (``spark.checkpoint.dir``). Only a local
    session without one, all of whose tasks run in this process, gets a temporary
    folder. Old checkpoints go with the objects that hold them if the session
    was started with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gradus-"))
    return df.checkpoint()


def width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
