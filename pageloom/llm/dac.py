"""Token files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds every id's lowest chunk and a bitmap
of the ids that go on; level 1 holds the next chunk of those that do, and so on. A rank
directory counts the set bits before every 512th, so the place of an id's next chunk is
found at once and any token is read without decoding a block.

A shard is one binary value: a header, the documents' ids and starts, then the levels
(chunks, bitmap, rank directory). Shards are rows of a Parquet table that Spark commits
(``part``, ``seq``: their order), so lost executors leave no half-written files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import give_back, in_arrow, slices
from pageloom.llm.tokens import VOCABULARY, encoder, shipped

MAGIC, HEADER, BLOCK = b"DAC1", "<4sBxxxQQ", 512
#: A shard ends with the document that brings it to this many ids.
SHARD_TOKENS = 1 << 19
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, data binary"


def _pack_level(values: np.ndarray, more: np.ndarray | None) -> bytes:
    parts = [struct.pack("<Q", len(values)), values.astype(np.uint8).tobytes()]
    if more is not None:
        bits = np.zeros(-(-len(values) // BLOCK) * BLOCK, np.uint8)
        bits[:len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(1, dtype=np.int64))]).astype("<u4")
        parts += [np.packbits(bits, bitorder="little").tobytes(), ranks.tobytes()]
    return b"".join(parts)


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], levels: int) -> bytes:
    """The shard of some documents' ids. ``levels`` chunks must hold every id."""
    lengths = np.array([len(x) for x in ids], np.int64)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [struct.pack(HEADER, MAGIC, levels, len(doc_ids), int(lengths.sum())), known.tobytes(),
             np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
             np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    left = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    for level in range(levels):
        chunk = left & 0xFF
        left = left >> 8
        more = left > 0 if level < levels - 1 else None
        parts.append(_pack_level(chunk, more))
        if more is not None:
            left = left[more]
    return b"".join(parts)


class Shard:
    """A packed shard; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        magic, n_levels, self.n_docs, self.n_tokens = struct.unpack_from(HEADER, data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = struct.calcsize(HEADER)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        known = take("u1", self.n_docs)
        ids = take("<i8", self.n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known)]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for level in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, blocks = take("u1", n), -(-n // BLOCK)
            last = level == n_levels - 1
            self.levels.append((chunks, None if last else take("u1", blocks * BLOCK // 8), None if last else take("<u4", blocks + 1)))

    def _rank(self, level: int, i: int) -> int:
        _, bits, ranks = self.levels[level]
        a = i // BLOCK * BLOCK
        return int(ranks[i // BLOCK]) + int(np.unpackbits(bits[a // 8:-(-i // 8)], bitorder="little")[:i - a].sum())

    def token(self, i: int) -> int:
        """The ``i``-th id of the shard, by one rank a level."""
        out, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            out |= int(chunks[i]) << (8 * level)
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                return out
            i, level = self._rank(level, i), level + 1

    def tokens(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids from ``a`` up to ``b``; only these are read."""
        chunks, bits, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        if bits is not None and b > a:
            more = np.unpackbits(bits[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a].astype(bool)
            if n := int(more.sum()):
                at = self._rank(level, a)
                out[more] |= self.tokens(at, at + n, level + 1) << np.uint32(8)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 0,
                 shard_tokens: int = SHARD_TOKENS, order: str = "doc_id", forget: bool = False) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write the shards in ascending order of the column ``order``.

    Rows alike in ``order`` follow each other by ``doc_id``. With ``forget`` a worker drops its remembered pieces after
    each task: less memory for what runs in it later, at some CPU time.
    ``end_id`` follows every document. A null text counts as empty. Rows without an id
    come first; rows with the same id follow each other, ordered by their text's hash.
    An empty table gives an empty shard table. Other columns are not read.
    """
    spec = shipped(docs, vocabulary)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = [] if order == "doc_id" else [F.col(order).alias("_order")]
    by = ["_order", "doc_id"] if first else ["doc_id"]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *first)
                   .repartitionByRange(parts, *by).sortWithinPartitions(*by, F.xxhash64("text")).select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc, part, seq = encoder(spec), TaskContext.get().partitionId(), 0
        levels = -(-max(enc.size - 1, end_id, 1).bit_length() // 8)
        end = np.array([end_id], enc.dtype).tobytes()
        keys, ids, held = [], [], 0

        def shard() -> pa.RecordBatch:
            row = ([part], [seq], [len(keys)], [held], [pack_shard(keys, ids, levels)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)],
                                              names=["part", "seq", "n_docs", "n_tokens", "data"])

        for batch in slices(batches, "text", 2 << 20):
            for key, coded in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                keys.append(key)
                ids.append(np.frombuffer(coded + end, enc.dtype))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield shard()
                    keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield shard()
        if forget:
            enc.forget()
            give_back()

    ordered.transform(in_arrow, run, SHARD_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts all ids before it.

    ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, "data", 1):
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "data"))):
                s = Shard(data)
                crcs = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(s.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * s.n_docs, pa.int32()), pa.array([seq] * s.n_docs, pa.int32()), pa.array(s.doc_ids, pa.int64()),
                     pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "data").transform(
        in_arrow, run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Parts are summed first, so that only one row a part meets in one task.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    bases = (shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
                   .join(totals, F.col("part") == F.col("p"))
                   .select(F.col("part").alias("p"), F.col("seq").alias("q"), (F.col("part_start") + F.col("inside")).alias("base")))
    out = rows.join(bases, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q")))
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
