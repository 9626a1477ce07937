"""Ranked lexical search: exact top documents by per-term geometric blocking.

Documents become short vectors of the asked terms (one pass over the texts, written once), from which Spark takes the
corpus statistics. The index lies with the documents: a task cuts its vectors into chunks and, in each, the posting
list of a term into blocks of similar documents. A block stores the largest weight that any of its documents has at each
coordinate, so the sum over an item's terms bounds every score in the block. A block is skipped only if that bound is
below a score that as many documents as asked for are known to reach; all others are scored exactly.

The least scores to reach come from a set number of documents that are scored first, and rise chunk by chunk. Terms whose
greatest weights together stay below that score need no list of their own: a document with no other term can't reach it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import in_arrow, slices, staged_table

#: Items answered in one pass over the vectors, and the bytes of their texts: what is broadcast for a pass.
ITEMS, ITEM_BYTES = 2_000, 8 << 20
#: Documents scored first for the scores to reach. A larger number skips more blocks and changes no result.
SEEDS = 4_096
#: Cells (documents x terms) of a chunk, documents of a chunk, documents of a block, numbers of a document's sketch.
CELLS, CHUNK, BLOCK, SKETCH = 4 << 20, 1_024, 32, 32

#: Bytes outside the terms become spaces, A-Z are lower-cased; bytes of longer characters belong to terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Items:
    """A block of items: their numbers, and per item the term numbers with how often the item holds each."""

    known: dict[bytes, int]
    asked: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(texts: list[str | None]) -> "Items":
        known: dict[bytes, int] = {}
        asked = []
        for text in texts:
            held = Counter(terms((text or "").encode()))
            at = np.array([known.setdefault(t, len(known)) for t in held], np.int64)
            asked.append((at, np.array(list(held.values()), np.int64)))
        return Items(known, asked)


def _vectors(docs: DataFrame, doc_id: str, text: str, known: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, at, tf``: a document's number of terms, and its asked terms with their frequencies; rows without a term go."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        look = sent.value
        for batch in slices(batches, "text"):
            n, at, tf = [], [], []
            for body in batch.column("text"):
                found = terms(body.as_py() or b"")
                held = {look[t]: c for t, c in Counter(found).items() if t in look}
                n.append(len(found))
                at.append(np.fromiter(held.keys(), np.int32, len(held)))
                tf.append(np.fromiter(held.values(), np.int32, len(held)))
            some = pa.array([x > 0 for x in n])
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())),
                                               pa.array(tf, pa.list_(pa.int32()))], names=["doc_id", "n", "at", "tf"])
            yield made.filter(some)

    return in_arrow(rows, run, "doc_id long, n long, at array<int>, tf array<int>")


def _share(tf, n, docs: int, total: int):
    """A term's part of a score, before its weight: whole numbers, divided downwards (for arrays)."""
    m = 75 + 25 * n * docs // max(total, 1)
    return 1_000_000_000 * tf // (1_000 * tf + 12 * m)


@dataclass(frozen=True)
class Ranker:
    """What a task needs for a block of items; its size follows the items, never the documents."""

    docs: int
    total: int
    asked: list[tuple[np.ndarray, np.ndarray]]  # per item: terms, weights (repeats included)
    most: np.ndarray                            # per term: its greatest share in any document
    reach: np.ndarray                           # per item: a score that enough documents reach, or 1
    limit: int

    def essential(self, item: int) -> np.ndarray:
        """The item's terms that need their own list, as places among its terms."""
        at, weight = self.asked[item]
        most = weight * self.most[at]
        order = np.argsort(most, kind="stable")
        below = np.cumsum(most[order]) < self.reach[item]
        return order[~below & (most[order] > 0)]


class _Best:
    """The best documents of one item so far in a task."""

    def __init__(self, reach: int, limit: int):
        self.reach, self.limit = int(reach), limit
        self.scores, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.reach
        if not good.any():
            return
        s, i, m = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((i, m, -s))[:self.limit]
        self.scores, self.ids, self.null = s[order], i[order], m[order]
        if len(order) == self.limit:
            self.reach = max(self.reach, int(self.scores[-1]))


class Chunk:
    """Some documents with the blocks of their posting lists."""

    def __init__(self, shares: np.ndarray, ids: np.ndarray, null: np.ndarray):
        """``shares``: documents x terms."""
        self.shares, self.ids, self.null = shares, ids, null
        # A fixed random projection: near documents have near sketches. It sets the blocks' shape, never a result.
        spread = np.random.default_rng(7).standard_normal((shares.shape[1], SKETCH)).astype(np.float32)
        sketch = shares.astype(np.float32) @ spread
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The term's documents, those of a block in a row, and the blocks' starts."""
        held = np.flatnonzero(self.shares[:, term])
        if len(held) <= BLOCK:
            return held, np.zeros(min(len(held), 1), np.int64)
        centres = held[np.linspace(0, len(held) - 1, -(-len(held) // BLOCK)).astype(np.int64)]
        near = np.argmax(self.sketch[held] @ self.sketch[centres].T, axis=1)
        order = np.argsort(near, kind="stable")
        return held[order], np.flatnonzero(np.diff(near[order], prepend=-1))

    def search(self, ranker: Ranker, best: list[_Best], lists: dict[int, list[int]]) -> tuple[int, int]:
        """Offers every document that can be among an item's best; returns how many blocks there were and how many were scored."""
        met: dict[int, list[np.ndarray]] = {}
        seen = scored = 0
        for term, items in lists.items():
            held, starts = self.blocks(term)
            if not len(held):
                continue
            coords = np.unique(np.concatenate([ranker.asked[i][0] for i in items]))
            # The summary: per block and coordinate, the largest share of its documents.
            summary = np.maximum.reduceat(self.shares[np.ix_(held, coords)], starts, axis=0).astype(np.int64)
            ends = np.append(starts[1:], len(held))
            for item in items:
                at, weight = ranker.asked[item]
                bound = summary[:, np.searchsorted(coords, at)] @ weight
                open_ = np.flatnonzero(bound >= best[item].reach)
                seen, scored = seen + len(starts), scored + len(open_)
                if len(open_):
                    met.setdefault(item, []).extend(held[starts[b]:ends[b]] for b in open_)
        for item, found in met.items():
            rows = np.unique(np.concatenate(found))
            at, weight = ranker.asked[item]
            best[item].offer(self.shares[np.ix_(rows, at)].astype(np.int64) @ weight, self.ids[rows], self.null[rows])
        return seen, scored


def _lists(ranker: Ranker) -> dict[int, list[int]]:
    """Which items read the list of a term."""
    out: dict[int, list[int]] = {}
    for item, (at, _) in enumerate(ranker.asked):
        for place in ranker.essential(item):
            out.setdefault(int(at[place]), []).append(item)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], ranker: Ranker) -> Iterator[Chunk]:
    width = len(ranker.most)
    size = max(1, min(CHUNK, CELLS // max(width, 1)))
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            part = batch.slice(a, size)
            counts = pa.compute.list_value_length(part.column("at")).to_numpy(zero_copy_only=False).astype(np.int64)
            n = part.column("n").to_numpy(zero_copy_only=False)
            at, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf"))
            shares = np.zeros((part.num_rows, width), np.int32)
            shares[np.repeat(np.arange(part.num_rows), counts), at] = _share(tf, np.repeat(n, counts), ranker.docs, ranker.total)
            ids = part.column("doc_id")
            yield Chunk(shares, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False))


def _best_of_tasks(vectors: DataFrame, ranker: Ranker) -> DataFrame:
    """``item, doc_id, score``: the best documents of every task; among them are the best of all."""
    sent = vectors.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ranker = sent.value
        best = [_Best(r, ranker.limit) for r in ranker.reach]
        lists = _lists(ranker)
        for chunk in _chunks(batches, ranker):
            chunk.search(ranker, best, lists)
        for item, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), item), pa.int32()), pa.array(b.ids, mask=b.null), pa.array(b.scores)],
                                                 names=["item", "doc_id", "score"])

    return in_arrow(vectors, run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _answers(docs: DataFrame, texts: list[str | None], doc_id: str, text: str, limit: int) -> DataFrame | None:
    """``item, rank, doc_id, score`` for a block of items; None where no item or no document holds a term."""
    items = Items.of(texts)
    if not items.known:
        return None
    vectors = staged_table(_vectors(docs, doc_id, text, items.known), "lexical-vectors")
    whole = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
    count, total = whole["docs"], whole["total"] or 0
    if not count:
        return None
    one = vectors.select(F.col("n"), F.explode(F.arrays_zip("at", "tf")).alias("t")).select("n", "t.at", F.col("t.tf").cast("long").alias("tf"))
    one = one.withColumn("m", F.lit(75) + F.expr(f"(25 * n * {count}L) div {total}L"))
    # At most one row a term of the items.
    stats = one.groupBy("at").agg(F.count(F.lit(1)).alias("df"), F.max(F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")).alias("most")).collect()
    df, most = np.zeros(len(items.known), np.int64), np.zeros(len(items.known), np.int64)
    for r in stats:
        df[r["at"]], most[r["at"]] = r["df"], r["most"]
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = [(at, times * weight[at]) for at, times in items.asked]
    ranker = Ranker(count, total, asked, most, np.ones(len(asked), np.int64), limit)
    if count > SEEDS:
        some = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(-(-count // SEEDS))) == 0)
        last = _ranked(_best_of_tasks(some, ranker), limit).where(F.col("rank") == limit).select("item", "score").collect()
        for r in last:
            ranker.reach[r["item"]] = r["score"]
    return _ranked(_best_of_tasks(vectors, ranker), limit).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           limit: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``limit`` best documents with a score above 0, exactly.

    Terms are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased, of whole texts; null
    and empty texts have none, and documents without a term don't count. Scores are whole numbers (``_share`` times the
    term's weight); equal ones rank by id, null ids last. Repeated documents are rows of their own; an item's repeated
    rows count once, and rows of one item with different texts are answered apart. Items without a term that a document
    holds, empty tables: no rows. Only the named columns are read. Items are answered in blocks of a set number
    and size, each with a pass over the documents.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    passes = max(1, -(-size["n"] // (ITEMS // 2)), -(-(size["b"] or 0) // (ITEM_BYTES // 2)))
    dealt = staged_table(asked.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).cast("int")), "lexical-items")
    out = None
    for k in range(passes):
        block = dealt.where(F.col("pass") == k).select("item_id", "text").collect()
        found = _answers(docs, [r["text"] for r in block], doc_id, text, limit) if block else None
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), dealt.schema["item_id"]]))
            found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], T.StructType([dealt.schema["item_id"]]).add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType()))
