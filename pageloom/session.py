"""Session settings the operators assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state for the streaming operators.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(name: str, cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
