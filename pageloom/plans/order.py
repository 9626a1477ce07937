"""Position in a global order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.plans.stage import staged


def global_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based position of every row in ``order``.

    Rows are range-partitioned and sorted; each partition numbers its own rows and
    adds the size of the partitions before it. Only one count per partition meets
    in one place. The sorted rows are materialised first, so that both readers see
    the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                      .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # monotonically_increasing_id is the partition number shifted by 33 bits plus the row number.
    local = F.col("_at") % F.lit(1 << 33)
    return (ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + local + 1)
                  .drop("_part", "_at", "_before"))
