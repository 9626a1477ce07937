"""How many partitions to spread rows over before work that adaptive execution cannot foresee."""

from __future__ import annotations

from pyspark.sql import DataFrame

EXPANSION_BYTES = 4 << 20
MOST = 200_000
#: Spark gives a size beyond this to what it knows nothing of.
UNKNOWN = 1 << 60
#: Bytes of staged rows that count as one byte of a table: they are expanded already, and stored row by row.
STAGED = 8


def scan_bytes(df: DataFrame) -> int:
    """Estimated size of a scan, from the plan's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def expansion_partitions(df: DataFrame, most: int = MOST) -> int:
    """Partition count for rows that are about to be expanded many-fold.

    At least the session's shuffle partitions, and enough to keep each one near
    4 MB before the expansion. A fixed count also keeps adaptive execution from
    merging partitions that are small only until then. ``df`` should be close to
    its scan, where the size estimate is sound.
    """
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(floor, scan_bytes(df) // EXPANSION_BYTES))


def _read_bytes(df: DataFrame, leaf) -> int:
    """Bytes of the files that a leaf of the plan reads.

    A staged result keeps Spark's estimate of the plan that made it, which multiplies the sides of each join; its files tell.
    """
    if leaf.getClass().getSimpleName() != "LogicalRDD":
        size = int(str(leaf.stats().sizeInBytes()))
        return size if size < UNKNOWN else 0
    held = leaf.rdd().getCheckpointFile()
    if not held.isDefined():
        return 0
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held.get())
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength() // STAGED


def expanded_partitions(*dfs: DataFrame) -> int:
    """Partition count for shuffling rows that were expanded from their scans: by the files read, whatever came after.

    What was not read from files has no size and leaves the session's shuffle partitions.
    """
    spark, most = dfs[0].sparkSession, 0
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        most = max(most, sum(_read_bytes(df, leaves.apply(i)) for i in range(leaves.size())))
    return min(MOST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), most // EXPANSION_BYTES))
