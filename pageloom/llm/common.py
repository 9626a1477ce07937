"""Words, hashes and staging shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from pageloom.plans.stage import checkpoint_dir

#: Odd multipliers of the rolling hash and of the final mix.
STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: A worker forgets its remembered words beyond this many; longer words are not remembered.
REMEMBERED, LONGEST = 120_000, 80
#: Spark's limit on the bytes of a batch that goes to a worker, and the value for sessions that name none.
BATCH_SETTING, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def staged_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``; a session that names no bytes per batch gets a limit, as a number of rows bounds no texts."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, BATCH_LIMIT)
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def kept_in_worker(name: str, make):
    """One object per Python worker, kept from task to task (a cache, never results)."""
    home = sys.modules.setdefault("pageloom_worker", types.ModuleType("pageloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def word_hasher():
    """A function from a list of words (bytes) to their 64-bit hashes."""
    known = kept_in_worker("hashes", _Hashes)
    return lambda words: np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values; empty for fewer values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= STEP
        out += h[j:j + m]
    return mixed(out + np.uint64(n))


def covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that starts where ``hit``."""
    edge = np.zeros(n + width + 1, np.int32)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:n]) > 0


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, idle or with other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the GNU C library only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size.astype(np.int64)) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()
