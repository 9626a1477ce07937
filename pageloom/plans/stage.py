"""Materialise a result that several branches of a plan read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local master may do without one and gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="run-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage; the partitioning is kept, the lineage is cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
