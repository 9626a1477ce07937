"""Attempt log and request rates as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.operators.chat import ATTEMPTS_KEPT
from pageloom.operators.requests import client_ip

ATTEMPT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("provider", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("ok", T.BooleanType()), T.StructField("ms", T.DoubleType()),
    T.StructField("error", T.StringType())])
SHARDED = T.StructType([T.StructField("shard", T.IntegerType()), *ATTEMPT.fields])


class RecentProcessor(StatefulProcessor):
    """Keeps the newest attempts of one shard and emits what is kept."""

    def __init__(self, keep: int = ATTEMPTS_KEPT):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", ATTEMPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in ATTEMPT]
        best = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for pdf in rows:
            new = [tuple(None if v is None or v != v else v for v in r) for r in pdf[names].itertuples(index=False)]
            best = sorted(best + new, key=lambda r: (r[0], r[1]))[-self.keep:]
        rows_out = [(int(r[0]), int(r[1]), r[2], r[3], bool(r[4]), None if r[5] is None else float(r[5]), r[6]) for r in best]
        self.kept.put(rows_out)
        out = pd.DataFrame(rows_out, columns=names)
        out.insert(0, "shard", key[0])
        yield out

    def close(self) -> None:
        pass


def attempt_stream(attempts: DataFrame, keep: int = ATTEMPTS_KEPT, shards: int = 64) -> DataFrame:
    """Newest attempts per shard after every micro-batch.

    One global log would put the whole stream in one task. Each shard keeps
    ``keep`` rows, which always include its share of the global newest ``keep``;
    :func:`newest` merges them.
    """
    sharded = attempts.withColumn("shard", F.pmod(F.col("request_id"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=RecentProcessor(keep), outputStructType=SHARDED, outputMode="Update", timeMode="None")


def newest(emitted: DataFrame, keep: int = ATTEMPTS_KEPT) -> DataFrame:
    """Global newest ``keep`` attempts out of everything the shards emitted."""
    rows = emitted.select(*[f.name for f in ATTEMPT]).distinct()
    return rows.orderBy(F.col("request_id").desc(), F.col("seq").desc()).limit(keep)


def rate_stream(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests per client and tumbling window, closed ``late`` after the window ends."""
    keyed = requests.withColumn("client_ip", client_ip(F.col("headers")))
    return (keyed.withWatermark("ts", late).groupBy(F.window("ts", window), "client_ip")
                 .agg(F.count(F.lit(1)).alias("n"))
                 .select(F.col("window.start").alias("window_start"), "client_ip", "n"))


def latest_wins_stream(results: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drop repeated answers to one request that arrive within the lateness bound."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "request_id"])
