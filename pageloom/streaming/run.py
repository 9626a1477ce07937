"""Drive a stream over what has arrived and hand back its output as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pageloom.plans.stage import checkpoint_dir
from pageloom.session import SETTINGS


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Process all available input, however long it takes, then read the written batches back.

    Every micro-batch overwrites its own folder, so a retried batch leaves one
    copy. Progress and output live under the shared checkpoint folder. Without input the
    result is empty.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    # Keyed state needs the RocksDB store; a session that never named one gets it from here on.
    store = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(store) != SETTINGS[store]:
        spark.conf.set(store, SETTINGS[store])
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
                   .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        query.stop()
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{base}/out/batch=-1")
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
